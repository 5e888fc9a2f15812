import pytest

from factloom.llm.pii import bloom_has, bloom_of, deobfuscate, detect, find_pii, redact, source_span

PARTS = [("Maelin", "given"), ("Torvald", "given"), ("May", "given"), ("Velquist", "family"), ("Tarnow", "family"), ("Field", "family"), ("Calloway-Reth", "family"), ("Müllendorf", "family")]


def found(text):
    plain, at, spans = detect(text)
    out = []
    for kind, a, b in spans:
        s, e = source_span(at, a, b, plain, text)
        out.append((kind, text[s:e]))
    return sorted(out)


@pytest.mark.parametrize(
    "text, kind, passage",
    [
        ("Write to a.b+c@mail.quarrel.example before Friday.", "email", "a.b+c@mail.quarrel.example"),
        ("Login is jo_x (at) example.org; reset", "email", "jo_x (at) example.org"),
        ("Login is jo-x [at] mail [dot] quarrel [dot] example; reset", "email", "jo-x [at] mail [dot] quarrel [dot] example"),
        ("cc JO at dienst dot example on the thread", "email", "JO at dienst dot example"),
        ("bounced for jo33 @ works.example twice", "email", "jo33 @ works.example"),
        ("mail jо@exаmple.org now", "email", "jо@exаmple.org"),  # Cyrillic о and а
        ("call five five five oh one two three four five six today", "phone", None),
        ("call four one five five five five oh one nine two today", "phone", "four one five five five five oh one nine two"),
        ("Call +49 (0)30 23125 476.", "phone", "+49 (0)30 23125 476"),
        ("Phone: (808) 555-0183 (rings twice)", "phone", "(808) 555-0183"),
        ("Phone: +1 415 555 0179.", "phone", "+1 415 555 0179"),
        ("mobile 01.99.00.33.17, text", "phone", "01.99.00.33.17"),
        ("Order 4155550158 is late", "phone", None),
        ("Invoice 356-61-4953 is still open.", "id_number", None),
        ("SSN on the form: <b>356-61-4953</b>.", "id_number", "356-61-4953"),
        ("insured under 1 52 19 68 161 589 68 (social insurance number).", "id_number", "1 52 19 68 161 589 68"),
        ("Passport no. QZ3008381 expires", "id_number", "QZ3008381"),
        ("Part no. QZ3008381 is out of stock", "id_number", None),
        ("Lives at 96A St. Odran's Rd., Unit 12 now", "address", "96A St. Odran's Rd."),
        ("Moved to Lindenauer Straße 130a, 2. OG", "address", "Lindenauer Straße 130a"),
        ("Entrega en Plaza de las Garzas nº 319, Villaserena.", "address", "Plaza de las Garzas nº 319"),
        ("Livraison au '''253 bis avenue du Vieux-Lavoir''', 00412 Valmoire.", "address", "253 bis avenue du Vieux-Lavoir"),
        ("The Tannery Road closure lasted 24 days. Only 5 lane closures on the ring road.", "address", None),
        ("Meet in Room 14, Stone Court wing, at 10:30. Pinned left-pad@3.0.3; ping @yard-bot.", "email", None),
    ],
)
def test_one_passage(text, kind, passage):
    assert found(text) == ([(kind, passage)] if passage else [])


def test_offsets_map_back():
    text = "x​y: Café, mail jo [at] example [dot] org!"
    plain, at = deobfuscate(text)
    assert plain == "xy: Café, mail jo@example.org!" and len(at) == len(plain) + 1
    assert found(text) == [("email", "jo [at] example [dot] org")]


def test_names_redaction_and_dirt(spark):
    learn = [(100 + i, f"Ask {g} Quennell for the keys.") for i, g in enumerate(["Maelin", "Torvald", "May"])] + [(110 + i, f"Met Corvin {f} today.") for i, f in enumerate(["Velquist", "Tarnow", "Field"])]
    # Counts tell that may and field are everyday words.
    learn += [(120, "We may go to the field, or may not."), (121, "It may rain on the field.")]
    rows = [
        (1, "Met Dr. CORVIN QUENNELL and Velquist, Maelin."), (2, "Agreed with Torvald\nCalloway-Reth on it; T. Müllendorf too."), (3, "Asked Maelin about it. Velquist Bakery sent 3 boxes. It may field a team."),
        (4, None), (5, ""), (6, "corvin h. quennell, a@b.example"), (6, "corvin h. quennell, a@b.example"), *learn, (7, "word " * 20000 + "Maelin Tarnow"),
    ]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "chunk_id long, text string, pii_type string, start int")
    parts = spark.createDataFrame(PARTS + [(None, "given"), ("x", None)], "name_part string, part_kind string")
    got = {(r[0], r.pii_type, r.pii_text) for r in find_pii(df, parts, id="chunk_id", text="text").collect() if r[0] < 100}
    assert got == {
        (1, "person", "CORVIN QUENNELL"), (1, "person", "Velquist, Maelin"), (2, "person", "Torvald\nCalloway-Reth"), (2, "person", "T. Müllendorf"),
        (6, "person", "corvin h. quennell"), (6, "email", "a@b.example"), (7, "person", "Maelin Tarnow"),
    }
    out = {r.chunk_id: (r.redacted, r.n_pii) for r in redact(df.dropDuplicates(["chunk_id"]), parts, id="chunk_id", text="text").collect()}
    assert out[1] == ("Met Dr. [PERSON] and [PERSON].", 2) and out[6] == ("[PERSON], [EMAIL]", 2) and out[4] == (None, 0) and out[5] == ("", 0)
    assert out[7][0] == "word " * 20000 + "[PERSON]"
    empty = spark.createDataFrame([], df.schema)
    assert find_pii(empty, parts, id="chunk_id", text="text").collect() == []


def test_bloom_has_no_false_negatives(spark):
    words = [f"w{i}" for i in range(2000)] + ["müller", "o'vallin"]
    bloom = bloom_of(spark.createDataFrame([(w,) for w in words], "word string"))
    assert all(bloom_has(bloom, w) for w in words)
    assert sum(bloom_has(bloom, f"v{i}") for i in range(2000)) < 20


def test_everyday_words_by_their_counts(spark):
    rows = [(i, t) for i, t in enumerate(["Ask Rose Field today.", "A rose in the field.", "The field of one rose, the rose field.", "may field", "met torvald velquist", "Spoke with Maelin Ostrander.", "Maelin Ostrander again."])]
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    parts = spark.createDataFrame([*PARTS, ("Rose", "given")], "name_part string, part_kind string")
    got = {(r[0], r.pii_text) for r in find_pii(df, parts, id="chunk_id", text="text").collect()}
    # "rose field" and "may field" are everyday words in lower case; a partner of one known part alone is learned where it has no other use
    assert got == {(0, "Rose Field"), (3, "may field"), (4, "torvald velquist"), (5, "Maelin Ostrander"), (6, "Maelin Ostrander")}


def test_clauses_tell_what_a_number_is():
    assert found("The invoice was paid last month after long talks about the weather; passport no. QZ3008381 is on file") == [("id_number", "QZ3008381")]
    assert found("Passport office sent a very long letter about many other things, see invoice 356-61-4953 in it.") == []


def test_too_many_parts(spark):
    from factloom.llm.pii import name_lexicon

    with pytest.raises(ValueError):
        name_lexicon(spark.createDataFrame([("x",)], "text string"), spark.createDataFrame(PARTS, "name_part string, part_kind string"), most_parts=3)
