import random
import re

from factloom.llm.splitting import split_oversized

LIMIT, OVERLAP = 60, 12


def texts():
    rnd = random.Random(3)
    words = ["alpha", "be", "gamma.", "d", "epsilon!", "zetaé", "𝒳𝒴", "why?"]
    out = []
    for i in range(80):
        seps = [" ", " ", "\n"] if i % 3 else [" "]
        out.append("".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randrange(1, 60))))
    out += ["x" * 200, "y" * 60, "z" * 61, "\n" * 70, "", None, " " * 100 + "a", "one. " + "w" * 130 + " two", "𝒳" * 130, ("a" * 59 + "\n") * 4, ("b" * 60 + "\n") * 4]
    return out


def test_pieces_tile_the_text(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "id long, text string, line int, _at string")
    got = {}
    for r in split_oversized(df, text="text", start_line="line", limit=LIMIT, overlap=OVERLAP).collect():
        got.setdefault(r.id, []).append(r)
    for i, t in rows:
        pieces = sorted(got.get(i, []), key=lambda r: r.piece_no)
        if t is None:
            assert not pieces
            continue
        if len(t) <= LIMIT:
            assert [p.piece_text for p in pieces] == [t] and pieces[0].cut_kind is None
            continue
        at, prev, stops = 0, None, []
        for p in pieces:
            assert 0 < len(p.piece_text) <= LIMIT and p.overlap_chars <= OVERLAP
            over = p.piece_text[: p.overlap_chars]
            if prev is not None and over:
                assert prev.endswith(over) and (len(prev) == len(over) or prev[-len(over) - 1].isspace())
            begin = t.index(p.piece_text, at - p.overlap_chars if p.overlap_chars else at)
            body_at = begin + (p.overlap_chars + 1 if p.overlap_chars else 0)
            assert t[at:body_at].strip() == ""
            if prev is not None and not p.overlap_chars:  # inside a run, or after a word longer than the overlap
                assert not t[at : at + 1].isspace() or len(re.split(r"\s", prev)[-1]) > OVERLAP or prev[-1].isspace()
            at = begin + len(p.piece_text)
            assert p.piece_start == 5 + t[:begin].count("\n") and p.piece_end == 5 + t[:at].count("\n")
            prev = p.piece_text
            stops.append(at)
        assert t[at:].strip() == ""
        lines = t.split("\n")
        if max(map(len, lines)) <= LIMIT:
            kind = "line"
        elif max(len(s) for x in lines for s in re.split(r"(?<=[.!?])\s+", x)) <= LIMIT:
            kind = "sentence"
        else:
            kind = "word" if max(map(len, re.split(r"\s+", t))) <= LIMIT else "char"
        assert all(p.cut_kind == kind for p in pieces)
        if max(map(len, lines)) <= LIMIT - OVERLAP - 1:  # lines that leave room for the overlap are never cut
            ends = {e for e in range(len(t) + 1) if e == len(t) or t[e] == "\n"}
            assert all(e in ends for e in stops)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string, line int")
    assert split_oversized(df, text="text", start_line="line").collect() == []


def test_every_piece_keeps_its_whole_overlap(spark):
    sentence = ("abcdefg " * 187).strip() + "."
    texts = [" ".join([sentence] * 5), " ".join(["word"] * 1500) + "\n" + "tail " * 285]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, line int")
    rows = split_oversized(df, text="text", start_line="line").orderBy("id", "piece_no").collect()
    for a, b in zip(rows, rows[1:]):
        assert len(b.piece_text) <= 1500
        if a.id == b.id:
            assert 0 < b.overlap_chars <= 120 and a.piece_text.endswith(b.piece_text[: b.overlap_chars])
