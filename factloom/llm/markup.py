"""Clean text from notes with leftover HTML, Markdown, wiki and LaTeX markup, by layout-aware rendering.

Each text becomes one tree. Every construct of the four languages is read as an event on it: an element opens or
closes, or a passage stands as it is (fenced blocks, code spans, formulas, paths, the notes' own tags). Constructs of
the three lighter languages are the elements they stand for: a wiki heading is a heading, an itemize environment a
list, a tabular environment a table. One builder with implied end tags takes all events, and one renderer with
visibility rules writes all visible text: blocks on lines of their own, list items marked, table cells aligned,
headings marked, code and formulas as they were. The nodes know their language, so the tree also tells which languages
a text has.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import spread

LANGUAGES = ("html", "markdown", "wiki", "latex")

# Elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HIDDEN = frozenset("script style head template noscript title object iframe".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ref s samp small span strike strong sub sup time tt u var nowiki button select option textarea video audio canvas picture math svg".split())
KNOWN = VOID | BLOCK | HIDDEN | INLINE
#: What a new element ends when it is still open.
IMPLIED = {
    "p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    **{t: {"p"} for t in "ul ol dl table div h1 h2 h3 h4 h5 h6 pre blockquote section".split()},
}
SCOPE = {"li": {"ul", "ol"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}

#: LaTeX commands that stand without an argument.
SYMBOLS = frozenset(
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega item ldots dots cdots newline linebreak pagebreak newpage clearpage noindent par hline centering LaTeX TeX maketitle tableofcontents bigskip medskip smallskip quad qquad sum int prod infty times cdot leq geq neq pm rightarrow leftarrow small large footnotesize bfseries itshape ttfamily".split()
)
GREEK = dict(zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega".split(), "αβγδεζηθικλμνξπρστφχψω"))

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)", re.M)
_LIKELY = re.compile(r"[<&*_`\[{\\$~]|''|==|^#|^ {0,3}>|\|\||^ {0,3}(?:-[ \t]*){3,}$", re.M)
_OWN = re.compile(r"\[verified:[^\]\n]*\]|\[volatile\]|\{(?:explicit|observed|imported|inferred|user|tool|agent|document|from|until|supersedes)\b[^{}\n]*\}[ \t]*$", re.I | re.M)
_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:\\[\w\\. -]*?(?=[\s,;)\]]|$)", re.M)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_MATH = re.compile(r"\$\$(?=[^$]*\S)[^$]+\$\$|\\\((?:[^\\]|\\(?!\)))+\\\)|\\\[(?=\s|[^\]\n]*\\\])(?:[^\\]|\\(?!\]))+\\\]|(?<![\\$\w])\$(?=[^\s$])(?:[^$\n\\]|\\.)*(?<!\s)\$(?![\d$])", re.S)
_CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOWIKI = re.compile(r"<nowiki>(.*?)</nowiki>", re.S | re.I)
_MATHML = re.compile(r"<math\b([^<>]*)>(.*?)</math\s*>", re.S | re.I)
_SVG = re.compile(r"<svg\b[^<>]*>(.*?)</svg\s*>", re.S | re.I)
_TEX_NOTE = re.compile(r"<annotation\b[^<>]*tex[^<>]*>(.*?)</annotation\s*>", re.S | re.I)
_SVG_TEXT = re.compile(r"<text\b[^<>]*>(.*?)</text\s*>", re.S | re.I)
_ANY_TAG = re.compile(r"<[^<>]*>")
_LATEX_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\])?(?:(?<=minted\})\{[^{}\n]*\})?[ \t]*\n?(.*?)\\end\{\1\}", re.S)
_LATEX_VERB = re.compile(r"\\verb\*?([^\sA-Za-z*\\])([^\n]*?)\1")
_LATEX_FORMULA = re.compile(r"\\begin\{((?:equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign)\*?)\}.*?\\end\{\1\}", re.S)
_LATEX_TABLE = re.compile(r"\\begin\{(tabular\*?|tabularx|longtable)\}(?:\[[^\]\n]*\])?((?:\{(?:[^{}]|\{[^{}]*\})*\}){1,2})((?:(?!\\begin\{(?:tabular|longtable)).)*?)\\end\{\1\}", re.S)
_LATEX_RULES = re.compile(r"\\(?:hline|toprule|midrule|bottomrule|endhead|endfirsthead|endfoot|endlastfoot)\b|\\(?:cline|cmidrule)(?:\([a-z]+\))?\{[^{}]*\}")
_LATEX_BLOCK = re.compile(r"\\(begin|end)\{([A-Za-z*]+)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_LATEX_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*")
_LATEX_HEAD = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}")
_LATEX_ARG = re.compile(r"~?(?<![\w:\\])\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_LATEX_TWO = re.compile(r"(?<![\w:\\])\\(frac|dfrac|tfrac|href|textcolor|colorbox)\{([^{}\n]*)\}\{([^{}\n]*)\}")
PAIRED = frozenset("frac dfrac tfrac href textcolor colorbox".split())
_LATEX_ROOT = re.compile(r"(?<![\w:\\])\\sqrt(?:\[([^\]\n]*)\])?\{([^{}\n]*)\}")
_LATEX_BARE = re.compile(r"(?<![\w:\\])\\([A-Za-z]+)(?![A-Za-z{\\])")
_LATEX_ESC = re.compile(r"(?<!\\)\\([&%$])")
_MD_ESC = re.compile(r"(?<!\\)\\([\\*_`#+.!~>()\[\]{}|-])")
_WIKI_REDIRECT = re.compile(r"^(\s*(?:[-+*|]\s+|\d+[.)]\s+)?)#REDIRECT\s*(?=\[\[)|(?<=\s)#REDIRECT\s*(?=\[\[)", re.I | re.M)
_WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]+)((?:\|[^\[\]|\n]*)*)\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}\n]+\}\}")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$|(?<=\s)(={2,6}) ([^=\n]+?) \3(?=\s|$)", re.M)
_WIKI_TABLE = re.compile(r"\{\|([^\n]*)\n?(.*?)(?:\|\}|\Z)", re.S)
_WIKI_URL = re.compile(r"\[((?:https?|ftp)://[^\s\]]+)\s+([^\]\n]+)\]")
_WIKI_BOLD = re.compile(r"'''(?!')((?:[^'\n]|'(?!''))+?)'''(?!')")
_WIKI_ITALIC = re.compile(r"(?<!')''(?!')((?:[^'\n]|'(?!'))+?)''(?!')")
_MD_IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)")
_MD_LINK = re.compile(r"\[([^\[\]\n]+)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:\s+\"[^\"\n]*\")?\)")
_MD_REF = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
_MD_NOTE = re.compile(r"\[\^[^\]\s]+\]:?")
_MD_DEF = re.compile(r"^ {0,3}\[[^\]\n^]+\]:[ \t]+\S+.*$", re.M)
_MD_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_MD_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
_MD_QUOTE = re.compile(r"^ {0,3}>[ \t]?(?=\S)", re.M)
_MD_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$", re.M)
_MD_STRONG = re.compile(r"(?<![\w*\\])(\*{2,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])|(?<![\w_\\])(_{2,3})(?=[^\s_])([^\n]*?[^\s_])\3(?![\w_])")
_MD_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*]|[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]*[^\s_]|[^\s_])_(?![\w_])")
_MD_STRIKE = re.compile(r"(?<![\w~\\])~~(?=\S)([^~\n]+?)(?<=\S)~~(?![\w~])")


#: Names that Python writes with two underscores on each side; these are no emphasis.
DUNDER = frozenset("init main name file call str repr dict doc all version new del len iter next enter exit getattr setattr class module slots future pycache eq hash getitem setitem contains add".split())
#: Templates that show nothing of what they are given, and those that show it whole.
SILENT = frozenset("stub|citation needed|cn|fact|cleanup|refimprove|unreferenced|reflist|notelist|toc|defaultsort|clear|short description|use dmy dates|use mdy dates|coord|authority control|when|who|which|by whom|clarify|dead link|better source|pov|disputed|update|infobox|navbox|sidebar|commons|portal".split("|"))
FORMULAS = frozenset("math formula mvar tmath bigmath".split())


class _Node:
    __slots__ = ("tag", "attrs", "kids", "lang")

    def __init__(self, tag: str, attrs: dict[str, str | None], lang: str | None = None):
        self.tag, self.attrs, self.kids, self.lang = tag, attrs, [], lang


#: Elements nested deeper become neighbours; their text is kept.
DEEPEST = 100


class _Builder:
    """A tree of elements and passages from events."""

    def __init__(self) -> None:
        self.root = _Node("root", {})
        self.open = [self.root]

    def start(self, tag: str, attrs: dict[str, str | None], lang: str | None) -> None:
        ends, scope = IMPLIED.get(tag, ()), SCOPE.get(tag, ())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self.open.pop()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in scope or self.open[k].tag == "table":
                break
            if self.open[k].tag == tag and tag in ends:
                del self.open[k:]
                break
        node = _Node(tag, attrs, lang)
        self.open[-1].kids.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def end(self, tag: str, lang: str | None) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag == "table":
                break
        self.passage("", lang)

    def passage(self, text: str, lang: str | None) -> None:
        node = _Node("passage", {}, lang)
        node.kids.append(text)
        self.open[-1].kids.append(node)

    def text(self, text: str) -> None:
        if text:
            self.open[-1].kids.append(text)

    def languages(self) -> set[str]:
        found, todo = set(), [self.root]
        while todo:
            node = todo.pop()
            found.add(node.lang)
            todo.extend(k for k in node.kids if not isinstance(k, str))
        return found - {None}


class _Renderer:
    def __init__(self) -> None:
        self.out: list[str] = []

    def line(self) -> None:
        """A new line, if the present one has anything on it."""
        for s in reversed(self.out):
            bare = s.rstrip(" ")
            if bare:
                if bare[-1] != "\n":
                    self.out.append("\n")
                return

    def walk(self, node: _Node, marks: list) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                self.out.append(kid)
                continue
            tag, attrs = kid.tag, kid.attrs
            if tag == "passage":
                self.out.append(kid.kids[0])
                continue
            if tag in HIDDEN or "hidden" in attrs or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
                continue
            if tag in ("br", "hr"):
                self.out.append("\n")
            elif tag == "img":
                self.out.append(html.unescape(attrs.get("alt") or ""))
            elif tag == "table":
                self.line()
                self.table(kid)
                self.line()
            elif tag in ("code", "kbd", "samp", "tt", "nowiki"):
                inner = _render(kid)
                self.out.append(f"`{inner}`" if inner.strip() and "`" not in inner and tag != "nowiki" else inner)
            elif tag == "pre":
                self.line()
                self.out += ["```\n", _render(kid).strip("\n"), "\n```"]
                self.line()
            elif tag in BLOCK:
                self.line()
                if tag == "li":
                    mark = marks[-1] if marks else None
                    depth = "  " * max(0, len(marks) - 1)
                    if mark and mark[0] == "ol":
                        mark[1] += 1
                        self.out.append(f"{depth}{mark[1]}. ")
                    else:
                        self.out.append(f"{depth}- ")
                elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                    self.out.append("#" * int(tag[1]) + " ")
                elif tag == "dd":
                    self.out.append("  ")
                self.walk(kid, [*marks, [tag, 0]] if tag in ("ul", "ol") else marks)
                self.line()
            else:
                self.walk(kid, marks)

    def table(self, node: _Node) -> None:
        rows: list[list[str]] = []
        for at in self.rows(node):
            cells = [c for c in at.kids if not isinstance(c, str) and c.tag in ("td", "th")] if at.tag == "tr" else [at]
            rows.append([re.sub(r"\s+", " ", _render(c)).strip() for c in cells])
        widths = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
        for r in rows:
            self.out += [" | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip(), "\n"]

    def rows(self, node: _Node) -> Iterator[_Node]:
        for kid in node.kids:
            if not isinstance(kid, str):
                if kid.tag in ("tr", "td", "th", "caption"):
                    yield kid
                else:
                    yield from self.rows(kid)


def _render(node: _Node) -> str:
    r = _Renderer()
    r.walk(node, [])
    return "".join(r.out)


class _Reader:
    """Turns a text into events: each construct is replaced by a numbered mark, in an order in which none hides another."""

    def __init__(self) -> None:
        self.events: list[tuple[str, str, dict, str | None, str]] = []  # what, tag or text, attributes, language, source

    def mark(self, what: str, value: str, lang: str | None, source: str = "", attrs: dict | None = None) -> str:
        self.events.append((what, value, attrs or {}, lang, source))
        return f"\ue000{len(self.events) - 1}\ue001"

    def source(self, text: str) -> str:
        """A passage as it was written."""
        while "\ue000" in text:
            text = _MARK.sub(lambda m: self.events[int(m[1])][4], text)
        return text

    def as_is(self, text: str, lang: str | None = None) -> str:
        whole = self.source(text)
        return self.mark("passage", whole, lang, whole)

    def element(self, tag: str, inner: str, lang: str, source: str) -> str:
        """An element around what may hold further constructs; its source stands with its first mark."""
        return self.mark("start", tag, lang, source) + inner + self.mark("end", tag, lang)

    def shown(self, text: str, lang: str, source: str) -> str:
        return self.mark("passage", text, lang, source)

    def fences(self, text: str) -> str:
        """Fenced blocks set aside, the last maybe never closed."""
        parts, at, opened = [], 0, None
        for m in _FENCE.finditer(text):
            if opened is None:
                parts.append(text[at : m.start()])
                opened = m.start()
            else:
                end = text.find("\n", m.start())
                end = len(text) if end < 0 else end
                parts.append(self.as_is(text[opened:end]))
                at, opened = end, None
        parts.append(self.as_is(text[opened:]) if opened is not None else text[at:])
        return "".join(parts)

    def tag(self, m: re.Match) -> str:
        name, whole = m[1].lower(), m.group()
        if name not in KNOWN:
            return whole
        if whole[1] == "/":
            return self.mark("end", name, "html", whole)
        attrs = {a.lower(): next((html.unescape(v) for v in vs if v), None if not any(vs) else "") for a, *vs in _ATTRIBUTE.findall(whole[1 + len(name) :])}
        return self.mark("start", name, "html", whole, attrs) + (self.mark("end", name, None) if whole.endswith("/>") and name not in VOID else "")

    def html(self, t: str) -> str:
        t = _COMMENT.sub(lambda m: self.shown("", "html", m.group()), t)
        if "<" in t:
            t = _NOWIKI.sub(lambda m: self.shown(html.unescape(self.source(m[1])), "html", m.group()), t)
            t = _MATHML.sub(self.mathml, t)
            t = _SVG.sub(lambda m: self.shown(" ".join(_plain(x) for x in _SVG_TEXT.findall(self.source(m[1]))), "html", m.group()), t)
            t = _TAG.sub(self.tag, t)
        return t

    def mathml(self, m: re.Match) -> str:
        inner = self.source(m[2])
        tex = _TEX_NOTE.search(inner)
        alt = re.search(r"""alttext=["']([^"']*)""", m[1])
        formula = html.unescape(tex[1]) if tex else html.unescape(alt[1]) if alt else _plain(inner)
        return self.shown(f"${formula.strip()}$", "html", m.group())

    def formulas(self, t: str) -> str:
        if "\\begin" in t:
            t = _LATEX_FORMULA.sub(lambda m: self.as_is(m.group(), "latex"), t)
        return _MATH.sub(lambda m: self.as_is(m.group(), "latex"), t) if "$" in t or "\\" in t else t

    def verbatim(self, t: str) -> str:
        if "\\" not in t:
            return t
        t = _LATEX_VERBATIM.sub(lambda m: self.mark("start", "pre", "latex", m.group()) + self.mark("passage", self.source(m[2]), None) + self.mark("end", "pre", "latex"), t)
        return _LATEX_VERB.sub(lambda m: self.shown(f"`{self.source(m[2])}`", "latex", m.group()), t)

    def latex(self, t: str) -> str:
        if "\\" not in t:
            return t
        if "\\begin" in t:
            t = _until_still(lambda x: _LATEX_TABLE.sub(self.tabular, x), t)
        blocks = {"itemize": "ul", "enumerate": "ol", "description": "ul", "quote": "blockquote", "quotation": "blockquote", "verbatim": "pre"}
        t = _LATEX_BLOCK.sub(lambda m: self.mark("end" if m[1] == "end" else "start", blocks.get(m[2].rstrip("*"), "div"), "latex", m.group()), t)
        t = _LATEX_ITEM.sub(lambda m: self.mark("start", "li", "latex", m.group()), t)
        level = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
        t = _LATEX_HEAD.sub(lambda m: self.element(f"h{level[m[1]]}", m[2], "latex", m.group()), t)

        def deeper(x: str) -> str:
            x = _LATEX_TWO.sub(lambda m: self.element("span", f"({m[2]})/({m[3]})" if m[1].endswith("frac") else m[3], "latex", m.group()), x)
            x = _LATEX_ROOT.sub(lambda m: self.element("span", f"√({m[2]})", "latex", m.group()), x)
            whole = lambda m: m[1] in PAIRED and x[m.end() : m.end() + 1] == "{"
            return _LATEX_ARG.sub(lambda m: m.group() if whole(m) else self.command(m), x)

        t = _until_still(deeper, t)
        t = _until_still(lambda x: _LATEX_ARG.sub(self.command, x), t)  # pairs that never close
        t = _LATEX_BARE.sub(lambda m: self.shown(GREEK.get(m[1], ""), "latex", m.group()) if m[1] in SYMBOLS else m.group(), t)
        t = _LATEX_ESC.sub(lambda m: self.shown(m[1], "latex", m.group()), t)
        return _MD_ESC.sub(lambda m: self.shown(m[1], "markdown", m.group()), t)

    def command(self, m: re.Match) -> str:
        name, arg = m[1], m[2]
        space = " " if m.group()[0] == "~" else ""
        if name in ("label", "index", "vspace", "hspace", "input", "include", "bibliography"):
            return self.shown(space, "latex", m.group())
        if name in ("texttt", "verb", "code"):
            return self.shown(f"{space}`{self.source(arg)}`", "latex", m.group())
        return space + self.element("span", f"[{arg}]" if name.startswith("cite") else arg, "latex", m.group())

    def tabular(self, m: re.Match) -> str:
        rows = [[c.strip() for c in re.split(r"(?<!\\)&", r)] for r in re.split(r"\\\\(?:\[[^\]\n]*\])?|\\tabularnewline\b", _LATEX_RULES.sub("", m[3]))]
        return self.table([r for r in rows if any(r)], "latex", m.group())

    def table(self, rows: list[list[str]], lang: str, source: str) -> str:
        cell = lambda c: self.mark("start", "td", lang) + c + self.mark("end", "td", lang)
        row = lambda r: self.mark("start", "tr", lang) + "".join(map(cell, r)) + self.mark("end", "tr", lang)
        return self.mark("start", "table", lang, source) + "".join(map(row, rows)) + self.mark("end", "table", lang)

    def wiki_table(self, m: re.Match) -> str:
        rows = re.split(r"^[ \t]*\|-.*$", "\n" + m[2], flags=re.M)
        cells = lambda r: [c.strip() for line in r.split("\n") if line.strip() for c in re.split(r"\|\||!!", line.strip().lstrip("|!+").strip())]
        return self.table([cells(r) for r in rows if r.strip()], "wiki", m.group())

    def wiki_link(self, m: re.Match) -> str:
        name, label = m[1].strip(), m[2].split("|")[-1].strip()
        if name.lower().startswith(("category:", "kategorie:", "catégorie:", "categoría:")):
            return self.shown("", "wiki", m.group())
        if name.lower().startswith(("file:", "image:", "datei:", "fichier:", "archivo:")):
            return self.element("a", label, "wiki", m.group())
        return self.element("a", label or name, "wiki", m.group())

    def template(self, m: re.Match) -> str:
        name, *given = m.group()[2:-2].split("|")
        name = name.strip().lower()
        if name in FORMULAS:
            return self.shown(f"${self.source('|'.join(given)).strip()}$", "wiki", m.group())
        if name in SILENT or name.split(" ")[0] in SILENT:
            return self.shown("", "wiki", m.group())
        said = [g.strip() for g in given if g.strip() and not re.match(r"\s*[\w -]+=", g)]
        return self.element("span", " ".join(said[-1:] if name == "lang" else said), "wiki", m.group())

    def links(self, t: str) -> str:
        if "{|" in t:
            t = _WIKI_TABLE.sub(self.wiki_table, t)
        if "[" in t:
            t = _WIKI_REDIRECT.sub(lambda m: (m[1] or "") + self.shown("→ ", "wiki", m.group()[len(m[1] or "") :]), t)
            t = _WIKI_LINK.sub(self.wiki_link, t)
            t = _WIKI_URL.sub(lambda m: self.element("a", m[2], "wiki", m.group()), t)
            t = _MD_IMAGE.sub(lambda m: self.element("span", m[1], "markdown", m.group()), t)
            t = _until_still(lambda x: _MD_LINK.sub(lambda m: self.element("a", m[1], "markdown", m.group()), x), t)
            t = _MD_REF.sub(lambda m: self.element("a", m[1], "markdown", m.group()), t)
            t = _MD_DEF.sub(lambda m: self.shown("", "markdown", m.group()), t)
            t = _MD_NOTE.sub(lambda m: self.shown("", "markdown", m.group()), t)
        return t

    def wiki(self, t: str) -> str:
        if "{{" in t:
            t = _until_still(lambda x: _WIKI_TEMPLATE.sub(self.template, x), t)
        if "==" in t:
            t = _WIKI_HEAD.sub(lambda m: self.element(f"h{len(m[1] or m[3])}", m[2] or m[4], "wiki", m.group()), t)
        if "''" in t:
            bold = lambda x: _WIKI_BOLD.sub(lambda m: self.element("b", m[1], "wiki", m.group()), x)
            t = _until_still(lambda x: _WIKI_ITALIC.sub(lambda m: self.element("i", m[1], "wiki", m.group()), bold(x)), t)
        return t

    def strong(self, m: re.Match) -> str:
        inner = m[2] or m[4]
        return m.group() if m[3] == "__" and inner in DUNDER else self.element("strong", inner, "markdown", m.group())

    def markdown(self, t: str) -> str:
        if "<" in t:
            t = _MD_AUTO.sub(lambda m: self.shown(m[1], "markdown", m.group()), t)
        if "#" in t:
            t = _MD_HEAD.sub(lambda m: self.shown(m[1] + " ", "markdown", m.group()) + m[2], t)
        if ">" in t:
            t = _MD_QUOTE.sub(lambda m: self.shown("", "markdown", m.group()), t)
        t = _MD_RULE.sub(lambda m: self.shown("", "markdown", m.group()), t)
        if "*" in t or "_" in t or "~~" in t:

            def inner(x: str) -> str:
                x = _MD_STRONG.sub(self.strong, x)
                x = _MD_EM.sub(lambda m: m.group() if m.group().strip("_") in DUNDER else self.element("em", m[1] or m[2], "markdown", m.group()), x)
                return _MD_STRIKE.sub(lambda m: self.element("del", m[1], "markdown", m.group()), x)

            t = _until_still(inner, t)
        return t

    def entity(self, m: re.Match) -> str:
        plain = html.unescape(m.group())
        return m.group() if plain == m.group() else self.shown(plain.replace("\xa0", " "), "html", m.group())

    def tree(self, text: str) -> _Builder:
        t = re.sub("[\ue000\ue001]", lambda m: self.mark("passage", m.group(), None, ""), text) if "\ue000" in text or "\ue001" in text else text
        t = _OWN.sub(lambda m: self.as_is(m.group()), self.fences(t))
        t = _CODE.sub(lambda m: self.as_is(m.group(), "markdown"), self.verbatim(t))
        t = _PATH.sub(lambda m: self.as_is(m.group()), t)
        for step in (self.html, self.formulas, self.latex, self.links, self.wiki, self.markdown):
            t = step(t)
        t = _ENTITY.sub(self.entity, t) if "&" in t else t
        made, at = _Builder(), 0
        for m in _MARK.finditer(t):
            made.text(t[at : m.start()])
            what, value, attrs, lang, _ = self.events[int(m[1])]
            if what == "start":
                made.start(value, attrs, lang)
            else:
                (made.end if what == "end" else made.passage)(value, lang)
            at = m.end()
        made.text(t[at:])
        return made


_MARK = re.compile("\ue000(\\d+)\ue001")


def _until_still(step, text: str) -> str:
    """Applies a step until it changes nothing: each change sets a construct aside, so this ends."""
    while (new := step(text)) != text:
        text = new
    return text


def _plain(text: str) -> str:
    """Text between tags."""
    return html.unescape(re.sub(r"\s+", " ", _ANY_TAG.sub(" ", text))).strip()


def render(text: str) -> tuple[str, frozenset[str]]:
    """The clean text, and the languages of the markup found in it."""
    if not text or not _LIKELY.search(text):
        return text, frozenset()
    made = _Reader().tree(text)
    found = made.languages()
    return (re.sub(r"[ \t]+(?=\n)", "", _render(made.root)) if found else text), frozenset(found)


def _cleaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(t) if t else (t, frozenset()) for t in batch.column(1).to_pylist()]
        heads = [None if h is None else [render(x) if x else (x, frozenset()) for x in h] for h in batch.column(2).to_pylist()]
        langs = lambda f: [x for x in LANGUAGES if x in f]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([t for t, _ in texts], pa.string()),
                pa.array([None if h is None else [x for x, _ in h] for h in heads], pa.list_(pa.string())),
                pa.array([langs(f) for _, f in texts], pa.list_(pa.string())),
                pa.array([langs(frozenset().union(*(f for _, f in h or ()))) for h in heads], pa.list_(pa.string())),
            ],
            ["id", "clean_text", "clean_headings", "text_markup", "heading_markup"],
        )


def clean_markup(df: DataFrame, *, id: str, text: str, headings: str) -> DataFrame:
    """(<id>, clean_text, clean_headings array, text_markup array, heading_markup array), one row for each row of df.

    Markup lists name html, markdown, wiki and latex where the field has at least one construct, entities, escapes and
    comments included. List marks, table pipes and fences of the notes, everything inside a fence, the tags
    ``[verified: ...]`` and ``[volatile]``, closing brace tags and look-alikes stay as they are and don't count. Null
    texts, headings and heading lists stay null; empty ones stay empty. Whole texts are read; other columns are not.
    """
    kind = df.schema[id].dataType.simpleString()
    rows = spread(df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(headings).alias("headings")), "id")
    made = rows.mapInArrow(_cleaner, f"id {kind}, clean_text string, clean_headings array<string>, text_markup array<string>, heading_markup array<string>")
    return made.withColumnRenamed("id", id)
