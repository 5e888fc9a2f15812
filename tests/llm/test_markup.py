import pytest

from factloom.llm.markup import clean_markup, render


@pytest.mark.parametrize(
    "text, clean, languages",
    [
        ("The **a** and *b* _c_ __d__ ~~f~~ `g*h*`.", "The a and b c d f `g*h*`.", {"markdown"}),
        ("[t](http://x/y) ![alt](x.png) [t][9] note[^3], <https://a.b/c> \\*lit\\*", "t alt t note, https://a.b/c *lit*", {"markdown"}),
        ("Area is 22 * 26 * 3. snake_case_names. C:\\new\\tables. $18,000 to $249,000. a < b and c > 0. Q&A. It said 'N' and \"N\".", None, set()),
        ("\\textit{o} \\& r~\\ref{t:x}, $\\alpha = 0.2$, \\[ c_i \\]", "o & r t:x, $\\alpha = 0.2$, \\[ c_i \\]", {"latex"}),
        ("\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", "\n- one\n- two\n", {"latex"}),
        ("{| class=\"w\"\n|-\n| name || n\n|-\n| longer one || 12\n|}", "name       | n\nlonger one | 12\n", {"wiki"}),
        ("'''b''' ''i'' [[A|b]] [[C]] {{stub|x}}", "b i b C ", {"wiki"}),
        ("== Head ==\ntext", "## Head\n\ntext", {"wiki"}),
        ("<ul><li>a<li>b</ul>", "- a\n- b\n", {"html"}),
        ("<table><tr><td>x<td>28<tr><td>long</table>", "x    | 28\nlong\n", {"html"}),
        ("<p>one<p>two<div hidden>no</div><script>no()</script><b style='display: none'>no</b>", "one\ntwo\n", {"html"}),
        ("a &amp; b&#8217;s <!-- no --> c<br>d", "a & b’s  c\nd", {"html"}),
        ("<code>x*y</code> <pre>\nkeep  it\n</pre>", "`x*y`\n```\nkeep  it\n```\n", {"html"}),
        ("```sh\n<b>x</b> **y**\n```\nafter **z**", "```sh\n<b>x</b> **y**\n```\nafter z", {"markdown"}),
        ("~~~\n**x** {{v}} &amp;", None, set()),
        ("- item [verified: 2024-01-02] {explicit, tool, from 2019-02-28}", None, set()),
        ("| a | b |\n1. c", None, set()),
    ],
)
def test_rendering(text, clean, languages):
    assert render(text) == (text if clean is None else clean, frozenset(languages))


def test_wide_and_deep_input_ends():
    assert len(render("<b>" * 300 + "x")[0]) == 1
    assert render("*" * 5000 + "a")[0] and render("[" * 5000)[0] and render("{{" * 3000)[0] and render("'" * 5000)[0] is not None


def test_table(spark):
    rows = [(1, "**x**", ["A &amp; B", None, ""]), (2, None, None), (3, "", []), (1, "**x**", ["A &amp; B", None, ""])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "chunk_id long, text string, heading_path array<string>, clean_text string")
    got = sorted(clean_markup(df, id="chunk_id", text="text", headings="heading_path").collect(), key=lambda r: r[0])
    assert [tuple(r) for r in got] == [(1, "x", ["A & B", None, ""], ["markdown"], ["html"])] * 2 + [(2, None, None, [], []), (3, "", [], [], [])]
    assert clean_markup(spark.createDataFrame([], df.schema), id="chunk_id", text="text", headings="heading_path").collect() == []


@pytest.mark.parametrize(
    "text, clean, languages",
    [
        (r"\begin{equation} E = \frac{a}{b} \end{equation}", r"\begin{equation} E = \frac{a}{b} \end{equation}", {"latex"}),
        (r"\begin{align*} \sqrt{y} &= 1 \end{align*}", r"\begin{align*} \sqrt{y} &= 1 \end{align*}", {"latex"}),
        ("\\begin{tabular}{l|r}\n\\hline\na & b \\\\\nccc & \\textbf{d} \\\\\n\\end{tabular}", "a   | b\nccc | d\n", {"latex"}),
        ("\\begin{verbatim}\n\\textbf{x} <b>y</b> **z**\n\\end{verbatim}", "```\n\\textbf{x} <b>y</b> **z**\n```\n", {"latex"}),
        (r"\verb|a_b{c}| and \frac{a}{\sqrt{b}}", "`a_b{c}` and (a)/(√(b))", {"latex"}),
        (r"\textbf{\emph{\underline{\textit{\textsc{\textsf{deep}}}}}}", "deep", {"latex"}),
        ("<math><mi>E</mi><mo>=</mo><mi>m</mi></math> <math>\\frac{a}{b}</math>", "$E = m$ $\\frac{a}{b}$", {"html"}),
        ("<svg><title>no</title><text x='1'>seen</text></svg>!", "seen!", {"html"}),
        ("{{formula|E=mc}} {{convert|5|km}} {{lang|fr|bonjour}}{{stub|x}} {{a|{{b|c}}}}", "$E=mc$ 5 km bonjour c", {"wiki"}),
        ("Call __init__ and _x_; __main__.", "Call __init__ and x; __main__.", {"markdown"}),
        ("Only __init__ here, and __name__.", None, set()),
        ("odd \ue0000\ue001 **x** \ue0017", "odd \ue0000\ue001 x \ue0017", {"markdown"}),
        ("**_~~*__**x**__*~~_**", "x", {"markdown"}),
        ("above\n\n---\n\nbelow", "above\n\n\n\nbelow", {"markdown"}),
        ("<a href='x?a=**b**&amp;c'>t</a> <img alt='a &lt; b'> <nowiki>'''k'''</nowiki>", "t a < b '''k'''", {"html"}),
        ("[![alt](i.png)](http://x/y)", "alt", {"markdown"}),
        ("</b> closes nothing", " closes nothing", {"html"}),
    ],
)
def test_formulas_tables_and_depth(text, clean, languages):
    got = render(text)
    assert got == (text if clean is None else clean, frozenset(languages))


def test_deep_elements_keep_their_text():
    assert render("<b>" * 3000 + "x" + "</b>" * 3000 + "y")[0] == "xy"
    assert render("<ul><li>" * 400 + "x")[0].strip().endswith("x")
