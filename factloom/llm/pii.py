"""Personal information in free text: found behind disguises, cut out with exact offsets, replaced by placeholders.

A text is first rewritten by transducers (homoglyphs and wide forms to plain characters, spelled digits to digits,
"(at)" and "[dot]" disguises to their signs, combining marks composed, invisible characters dropped), each output
character remembering the source characters it stands for. Identifiers are detected in the rewritten text and their
spans mapped back to the source, so what is reported and replaced is the passage as written.

Names take two passes. The first learns which words act as given and family names beside the known parts, from counts
over all texts; the second proposes pairs of words that a fixed-size Bloom filter of these words lets through, and an
exact join with the learned table confirms them. Neither table is ever assumed small.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, spread

TYPES = ("email", "phone", "id_number", "address", "person")

# Characters that are drawn like plain ones, and words for digits and signs.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαορνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠．－＋（）／‐‑‒–−    　０１２３４５６７８９٠١٢٣٤٥٦٧٨٩",
    "aeopcyxijshdqwABEKMHOPCTYXIJSaopvABEZHIKMNOPTYX@.-+()/-----     01234567890123456789",
)
DIGIT_WORDS = {
    w: str(d)
    for d, ws in enumerate(
        ("zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")
    )
    for w in ws.split()
}
_DIGIT_SET = frozenset(DIGIT_WORDS)
AT, DOT = "at|ät|arroba|arobase", "dot|punkt|punto|point"

_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Rewriting rules in order of precedence.
_RULES = {
    "invisible": r"[\u200b-\u200f\u2060\ufeff\u00ad]",
    "composed": r"\w[\u0300-\u036f]+",
    "spelled": rf"\b(?:{_DIGIT})(?:[ -]+(?:{_DIGIT})\b){{5,}}",
    "at": rf"(?<=\w)\s*[(\[{{]\s*(?:{AT}|@)\s*[)\]}}]\s*(?=\w)",
    "dot": rf"(?<=\w)\s*[(\[{{]\s*(?:{DOT}|\.)\s*[)\]}}]\s*(?=\w)",
    "said": rf"(?<=\w)\s+(?:{AT})\s+[\w-]+(?:\s+(?:{DOT})\s+[\w-]+)+",
    "spaced": rf"(?<=\w)(?:\s*@\s+|\s+@\s*)(?=[\w-]+(?:\.|\s*[(\[{{]\s*(?:{DOT})))",
}
_SAID = re.compile(rf"\s+(?P<at>{AT})\s+|\s+(?P<dot>{DOT})\s+", re.I)
_FOREIGN = re.compile("[" + "".join(re.escape(chr(c)) for c in HOMOGLYPHS) + "]")
_SPOKEN_DOTS = tuple(f" {w} " for w in DOT.split("|"))
_SPOKEN = re.compile(rf"\s(?:{AT})\s+[\w-]+\s+(?:{DOT})\s")
_BRACKETED = re.compile(rf"[(\[{{]\s*(?:{AT}|{DOT}|@|\.)\s*[)\]}}]", re.I)
_INVISIBLE, _COMBINING = re.compile(_RULES["invisible"]), re.compile(r"[\u0300-\u036f]")


@lru_cache(maxsize=None)
def _rewriting(rules: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{r}>{_RULES[r]})" for r in rules), re.I)


def _disguises(plain: str) -> tuple[str, ...]:
    """The rules that may apply to a text, by cheap tests."""
    found = []
    if not plain.isascii():
        found += ["invisible"] * bool(_INVISIBLE.search(plain)) + ["composed"] * bool(_COMBINING.search(plain))
    low = plain.lower()
    words = low.replace("-", " ").split()
    if sum(map(_DIGIT_SET.__contains__, words)) >= 5:  # the last of six may have a sign behind it
        found.append("spelled")
    if _BRACKETED.search(plain):
        found += ["at", "dot"]
    if any(w in low for w in _SPOKEN_DOTS) and _SPOKEN.search(low):
        found.append("said")
    if " @" in plain or "@ " in plain:
        found.append("spaced")
    return tuple(found)


def deobfuscate(text: str) -> tuple[str, np.ndarray | None]:
    """The plain form of a text, and for each of its characters and its end the offset in the source (None: the same)."""
    plain = text if text.isascii() or not _FOREIGN.search(text) else text.translate(HOMOGLYPHS)  # character for character
    rules = _disguises(plain)
    if not rules:
        return plain, None
    out: list[str] = []
    at: list[np.ndarray] = []

    def copy(a: int, b: int) -> None:
        out.append(plain[a:b])
        at.append(np.arange(a, b))

    def put(text: str, a: int) -> None:
        out.append(text)
        at.append(np.full(len(text), a))

    done = 0
    for m in _rewriting(rules).finditer(plain):
        copy(done, m.start())
        kind = m.lastgroup
        if kind in ("at", "dot", "spaced"):
            put("." if kind == "dot" else "@", m.start())
        elif kind == "composed":
            put(unicodedata.normalize("NFC", m.group()), m.start())
        elif kind == "spelled":
            for w in re.finditer(r"[^\W\d_]+", m.group()):
                put(DIGIT_WORDS[w.group().lower()], m.start() + w.start())
        elif kind == "said":
            last = 0
            for s in _SAID.finditer(m.group()):
                copy(m.start() + last, m.start() + s.start())
                put("@" if s["at"] else ".", m.start() + s.start())
                last = s.end()
            copy(m.start() + last, m.end())
        done = m.end()
    copy(done, len(plain))
    return "".join(out), np.concatenate([*at, [len(text)]]).astype(np.int64)


_EMAIL = re.compile(r"(?<![\w.+@/-])[^\W_][\w.+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w@])")

_PHONE = re.compile(
    r"(?<![\w.,:/+#(-])(?<!\d )(?<!\) )(?<!\()"
    r"(?:(?:\+|00)[1-9]\d{0,2}(?:[ .-]?\(0\))?(?:[ ./-]?\(\d{1,4}\))?(?:[ ./-]?\d){7,11}"  # international
    r"|(?:1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"  # area code of three digits
    r"|[2-9]\d{2}[2-9]\d{6}"
    r"|\(0\d{2,4}\)[ ]?\d{3,4}[ -]?\d{3,4}"  # area code with its zero
    r"|0\d{2,4}[ /-]\d{3,4}[ -]\d{4}"
    r"|0\d{2,4}[ /-]\d{5,8}(?:-\d{1,4})?"
    r"|0[1-9](?:[ .-]\d{2}){4})"
    r"(?![\w/]|[.,:-]\d)"
)
_NO_PHONE = re.compile(r"(?:invoice|order|ticket|serial|reference|ref|part|build|commit|version|isbn|sku|item|case|batch|rechnung|factura|facture|pedido|bestellung)(?:\s+(?:no|nr|number|n°|nº)\.?)?[ :#.]*$", re.I)

_ID = re.compile(
    r"(?<![\w/+.-])(?<!\d )"
    r"(?:[12] ?\d{2} ?(?:0[1-9]|[1-9]\d) ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2}"  # social security, with or without blanks
    r"|\d{3}(?:-\d{2}-|[ ]\d{2}[ ])\d{4}|\d{2}-\d{4}-\d{5}-\d|\d{2,3}/\d{3}/\d{4,5}"
    r"|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{1,2}\d{6,8}|(?=[A-Z]*\d|[A-Z]{9}(?![A-Z]))[A-Z][A-Z0-9]{8}|\d{9,15}|\d{8}[A-Z])"
    r"(?![\w/]|[-.]\d)"
)
#: What every identity or phone number begins with, as a search that skips from one possible first character to the next.
_ID_START = re.compile(r"[A-Z\d](?<![\w/+.-][A-Z\d])(?<!\d [A-Z\d])[A-Z\d /-]{7}")
_PHONE_START = re.compile(r"[+(\d](?<![\w.,:/+#(-][+(\d])(?<!\d [+(\d])(?<!\) [+(\d])[\d ()./+-]{6}")
_ID_CUE = re.compile(
    r"(?:\bssn\b|\bsocial\b|\bpass(?:port|eport|aporte)\b|\breisepass\b|\blicen[cs]e\b|\bführerschein\b|\bpermis\b|\bnational id\b|\bid[- ]?(?:card|number|no)\b|\bidentity\b|\bausweis|ausweis\b|\bpersonalausweis\b"
    r"|\bcédula\b|\bdni\b|\bnie\b|\bcarte d'identité\b|\btax(?:payer)?\b|\bsteuer|\bnif\b|\bsécu|\bsécurité sociale\b|\binsured\b|\binsurance\b|\bsozialversicherung|\bversicherten|\bnational insurance\b|\bseguridad social\b)",
    re.I,
)
_NO_ID = re.compile(r"(?:\binvoice|\border|\bticket|\bserial|\breference|\bpart|\bbuild|\bcommit|\bversion|\bbox)\b", re.I)

_SUFFIX = "street|st|road|rd|lane|ln|way|terrace|close|court|avenue|ave|boulevard|blvd|drive|place|square|crescent|gardens|mews|row|walk"
_NOT_STREET = "bis|ter|quater|the|a|an|of|on|in|at|to|per|for|and|or|more|days?|hours?|minutes?|weeks?|boxes|rows|seats|items|lane|ring"
_EDGE = r"[\w/.,:$€£#-]"
# Number first: each begins with a digit, so that the search skips from digit to digit.
_NUMBER_FIRST = re.compile(
    rf"\d(?<!{_EDGE}\d)(?:"
    rf"\d{{0,4}}(?:-\d{{1,5}})?[a-z]?[ ]+(?:[nsew]\.?[ ]+|st\.?[ ]+|old[ ]+|new[ ]+|upper[ ]+|lower[ ]+|great[ ]+)?(?!(?:{_NOT_STREET})\b)[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*[ ]+(?:{_SUFFIX})\b(?:(?<=\brd)\.)?"
    r"|\d{0,3}(?:[ ]?(?:bis|ter|quater))?,?[ ]+(?:rue|avenue|av\.|place|bd|boulevard|chemin|quai|impasse|allée|cours|route|passage|sentier)[ ]+(?:(?:de[ ]la|des|du|de|aux|au|à[ ]la)[ ]+|d['’]|de[ ]l['’])?[^\W\d_](?:[\w'’-]*\w)?"
    r")",
    re.I,
)
# Number last: these begin with any word, so they run only on texts that hold one of their street words.
_GERMAN = re.compile(
    rf"(?<!{_EDGE})(?:[^\W\d_]+(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|steig|markt)|[^\W\d_]+[ ](?:straße|strasse|str\.|platz|allee|gasse|weg|ring)"
    r"|(?:am|an[ ]der|auf[ ]dem|im|zum|zur)[ ](?:alten?|neuen?|hohen?|langen?|grünen?|oberen?|unteren?)[ ][^\W\d_]+)[ ]+\d{1,4}[a-z]?(?!\w)",
    re.I,
)
_SPANISH = re.compile(
    rf"(?<!{_EDGE})(?:calle|c/|avda\.|avenida|av\.|plaza|pza\.|paseo|camino|ronda|travesía)[ ]*(?:(?:de[ ]las|de[ ]los|de[ ]la|del|de)[ ]+)?[^\W\d_][\w-]*,?[ ]+(?:n[ºo°]\.?[ ]*)?\d{{1,4}}(?![\wº°])",
    re.I,
)
_GERMAN_WORDS = tuple("straße strasse str. gasse weg platz allee ufer damm ring steig markt".split()) + tuple(f" {w}" for w in "alte neue hohe lange grüne obere untere".split())
_SPANISH_WORDS = tuple("calle c/ avda. avenida av. plaza pza. paseo camino ronda travesía".split())
_CAPITALS, _DIGIT_CHAR = re.compile(r"[A-Z]{9}"), re.compile(r"\d")

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BETWEEN = re.compile(r"[ \t]{1,3}\Z|[ \t]*\n[ \t]{0,4}\Z")
_COMMA = re.compile(r",[ \t]{1,2}\Z")
_INITIAL = re.compile(r"\.[ \t]{0,2}\Z|\.[ \t]*\n[ \t]{0,4}\Z")
_TITLE = re.compile(r"(?:\b(?:dr|mr|mrs|ms|prof|sr|sra|srta|hr|herr|frau|mme|mlle|don|doña)\b\.?[ ]+)\Z", re.I)

_HANDLE = re.compile(r"\S*@\S*")
_CLAUSE_START = re.compile(r"[\n;|]|[.!?] (?=[A-ZÀ-Þ])")
_CLAUSE_END = re.compile(r"[\n;|]|[.!?](?: |\Z)")


class _Taken:
    """Disjoint intervals in order of their starts."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.spans = sorted(spans)

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.spans, (b, b))
        return k == 0 or self.spans[k - 1][1] <= a

    def add(self, a: int, b: int) -> bool:
        fits = self.free(a, b)
        if fits:
            bisect.insort(self.spans, (a, b))
        return fits


class _Clauses:
    """The clauses of a text: what stands in one line between semicolons, bars and sentence ends."""

    def __init__(self, plain: str) -> None:
        self.plain = plain
        self.starts: list[int] | None = None

    def before(self, a: int) -> str:
        if self.starts is None:
            self.starts = [0, *(m.end() for m in _CLAUSE_START.finditer(self.plain))]
        k = bisect.bisect_right(self.starts, a) - 1
        if k and self.starts[k] == a and self.plain[a - 1] == " ":  # a period just before is that of an abbreviation
            k -= 1
        return self.plain[self.starts[k] : a]

    def after(self, b: int) -> str:
        m = _CLAUSE_END.search(self.plain, b)
        return self.plain[b : m.start() if m else len(self.plain)]


def _from(start: re.Pattern, whole: re.Pattern, text: str) -> Iterator[re.Match]:
    """The matches of ``whole``, tried only where ``start`` matches, which each of them does."""
    at = 0
    while m := start.search(text, at):
        w = whole.match(text, m.start())
        if w:
            yield w
        at = w.end() if w else m.start() + 1


def _last(pattern: re.Pattern, text: str) -> int:
    """Where the last match ends; -1 without one."""
    return max((m.end() for m in pattern.finditer(text)), default=-1)


def detect(text: str) -> tuple[str, np.ndarray | None, list[tuple[str, int, int]]]:
    """The plain text, its offsets, and the spans (type, start, end in the plain text) of all but names."""
    plain, at = deobfuscate(text)
    spans: list[tuple[str, int, int]] = []
    if "@" in plain:
        spans += [("email", m.start(), m.end()) for m in _EMAIL.finditer(plain) if "." not in m.group().split("@")[0][-1:]]
    digits = _DIGIT_CHAR.search(plain)
    if digits or _CAPITALS.search(plain):
        taken, clauses = _Taken((a, b) for _, a, b in spans), _Clauses(plain)
        if digits:
            places = [m.span() for m in _NUMBER_FIRST.finditer(plain)]
            low = plain.lower()
            if any(w in low for w in _GERMAN_WORDS):
                places += [m.span() for m in _GERMAN.finditer(plain)]
            if any(w in low for w in _SPANISH_WORDS):
                places += [m.span() for m in _SPANISH.finditer(plain)]
            spans += [("address", a, b) for a, b in sorted(places) if taken.add(a, b)]
        for m in _from(_ID_START, _ID, plain):
            a, b = m.span()
            before = clauses.before(a)
            cue, other = _last(_ID_CUE, before), _last(_NO_ID, before)  # the nearer one tells what the number is
            if (cue > other or cue == other and _ID_CUE.search(clauses.after(b))) and taken.add(a, b):
                spans.append(("id_number", a, b))
        for m in _from(_PHONE_START, _PHONE, plain) if digits else ():
            a, b = m.span()
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15 and not _NO_PHONE.search(clauses.before(a)) and taken.add(a, b):
                spans.append(("phone", a, b))
    return plain, at, spans


def source_span(at: np.ndarray | None, a: int, b: int, plain: str, text: str) -> tuple[int, int]:
    """The source characters behind plain[a:b]: up to where the next plain character begins, less trailing white space."""
    if at is None:
        return a, b
    start, end = int(at[a]), int(at[b])
    while end > start and text[end - 1].isspace() and not plain[b - 1].isspace():
        end -= 1
    return start, end


#: Different words counted in a task before the counts are handed on.
MOST_WORDS = 1_000_000


def word_evidence(known: dict[str, set[str]]):
    """Counts of words by case, and of capitalised words beside known parts of names: (word, kind, partner, n)."""
    given, family = known["given"], known["family"]
    small = {w for part in known.values() for w in part}
    spelled = {f(w) for part in known.values() for w in part for f in (str.upper, str.title, str.capitalize, _titled)}

    def beside(plain: str, seen: Counter) -> None:
        words = [m for m in _WORD.finditer(plain) if m.group()[0].isupper()]
        for k, m in enumerate(words):
            word = m.group()
            if len(word) < 2 or word.isupper():
                continue
            low = word.casefold()
            prev, nxt = (words[k - 1] if k else None), (words[k + 1] if k + 1 < len(words) else None)
            p, n = prev.group().casefold() if prev else "", nxt.group().casefold() if nxt else ""
            left, right = plain[prev.end() : m.start()] if prev else "", plain[m.end() : nxt.start()] if nxt else ""
            if p in given and _BETWEEN.match(left) and low not in given and not (k > 1 and _COMMA.match(plain[words[k - 2].end() : prev.start()])):
                seen[low, "family", p] += 1
            elif n in given and _COMMA.match(right):
                seen[low, "family", n] += 1
            if n in family and _BETWEEN.match(right) and low not in family and not (k + 2 < len(words) and _COMMA.match(plain[nxt.end() : words[k + 2].start()])) and not _TITLE.search(word + " "):
                seen[low, "given", n] += 1
            elif p in family and _COMMA.match(left):
                seen[low, "given", p] += 1

    def told(uses: Counter, seen: Counter) -> pa.RecordBatch:
        for word, n in uses.items():
            if n > 0 and len(word) > 1 and not word.isupper():
                seen[word.casefold(), "capital" if word[0].isupper() else "lower", ""] += n
        keys = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([seen[k] for k in keys], pa.int64())], ["word", "kind", "partner", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, seen = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                plain, _ = deobfuscate(text)
                words = _WORD.findall(plain)
                uses.update(words)
                if "@" in plain:  # mail addresses and handles are no uses of a word
                    for handle in _HANDLE.findall(plain):
                        uses.subtract(_WORD.findall(handle))
                for k in [k for k, w in enumerate(words[:-1]) if w in small]:  # a name in lower case is no everyday use of its parts
                    if (other := words[k + 1]) in small and (words[k] in given) != (other in given):
                        seen[words[k], "lower", ""] -= 1
                        seen[other, "lower", ""] -= 1
                if not spelled.isdisjoint(words):
                    beside(plain, seen)
            if len(uses) > MOST_WORDS:
                yield told(uses, seen)
                uses, seen = Counter(), Counter()
        yield told(uses, seen)

    return run


def _titled(name: str) -> str:
    return "-".join(x.capitalize() for x in name.split("-"))


def name_lexicon(texts: DataFrame, parts: DataFrame, *, partners: int = 2, share: float = 0.3, everyday: float = 0.5, most_parts: int = 100_000) -> DataFrame:
    """(word, kind, is_everyday) of all known and learned parts of names, in folded case; kind is given or family.

    A word is learned when it stands beside at least ``partners`` different known parts of the other kind, in the
    right order, in at least ``share`` of its capitalised uses; beside a single known part, when it has no other use at
    all. A word is everyday when at least that share of all its uses is in lower case. ``texts`` has the one column
    text; ``parts`` has name_part and part_kind and is a table the user maintains, of at most ``most_parts`` rows (a
    larger one is an error).
    """
    rows = parts.filter("name_part is not null and part_kind in ('given', 'family')").select("name_part", "part_kind").distinct().limit(most_parts + 1).collect()
    if len(rows) > most_parts:
        raise ValueError(f"more than {most_parts} known parts of names")
    known = {k: {r["name_part"].casefold() for r in rows if r["part_kind"] == k} for k in ("given", "family")}
    counts = texts.mapInArrow(word_evidence(known), "word string, kind string, partner string, n bigint").groupBy("word", "kind", "partner").agg(F.sum("n").alias("n"))
    by_word = counts.groupBy("word").agg(
        *[F.count_if((F.col("kind") == k) & (F.col("partner") != "")).alias(f"{k}_partners") for k in ("given", "family")],
        *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_n") for k in ("given", "family", "capital", "lower")],
    )
    spark = texts.sparkSession
    base = spark.createDataFrame([(w, k, True) for k in known for w in sorted(known[k])], "word string, part string, is_known boolean")
    base = base.groupBy("word").agg(*[F.coalesce(F.max(F.when(F.col("part") == k, F.col("is_known"))), F.lit(False)).alias(f"known_{k}") for k in ("given", "family")])
    joined = by_word.join(base, "word", "full").fillna(0).fillna(False)

    def fits(k: str) -> Column:
        some = (F.col(f"{k}_partners") >= partners) & (F.col(f"{k}_n") >= share * F.col("capital"))
        alone = (F.col(f"{k}_partners") == 1) & (F.col(f"{k}_n") >= 2) & (F.col(f"{k}_n") == F.col("capital")) & (F.col("lower") == 0)
        return F.col(f"known_{k}") | some | alone

    joined = joined.withColumnsRenamed({"capital_n": "capital", "lower_n": "lower"})
    kinds = F.array(*[F.when(fits(k), F.lit(k)) for k in ("given", "family")])
    told = joined.select("word", F.explode(F.array_compact(kinds)).alias("kind"), ((F.col("lower") > 0) & (F.col("lower") >= everyday * (F.col("lower") + F.col("capital")))).alias("is_everyday"))
    return cut(told)


BLOOM_BITS = 23


def bloom_of(lexicon: DataFrame) -> bytes:
    """A bit for each hash of a word; 1 MB whatever the size of the lexicon."""
    bit = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(1 << BLOOM_BITS))
    rows = lexicon.select(bit.alias("b")).groupBy(F.bitmap_bucket_number(F.col("b")).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b"))).alias("bits")).collect()
    out = bytearray((1 << BLOOM_BITS) // 8 + 4096)
    for r in rows:  # bucket k holds the positions (k - 1) * 32768 + 1 .. k * 32768, except that 0 falls into bucket 0
        place = (r["k"] - 1) * 4096 + 0 if r["k"] else 0
        bits = bytes(r["bits"])
        if r["k"] == 0:
            out[(1 << BLOOM_BITS) // 8 :] = bits
        else:
            out[place : place + 4096] = bits
    return bytes(out)


def bloom_has(bloom: bytes, word: str) -> bool:
    b = zlib.crc32(word.encode()) % (1 << BLOOM_BITS)
    if b == 0:
        return bool(bloom[(1 << BLOOM_BITS) // 8] & 1)
    return bool(bloom[(b - 1) >> 3] >> ((b - 1) & 7) & 1)


def name_candidates(plain: str, maybe) -> list[tuple[int, int, str, str]]:
    """(start, end, given or "" for an initial, family) of word pairs that may be names."""
    bare = _WORD.findall(plain)
    likely = [k for k, w in enumerate(bare) if maybe(w)]
    if not any((k and len(bare[k - 1]) == 1) or (k + 1 < len(bare) and (len(bare[k + 1]) == 1 or maybe(bare[k + 1]))) for k in likely):
        return []
    found = []
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(plain)]
    for i, (a, b, w) in enumerate(words):
        initial = len(w) == 1
        if not (initial or maybe(w)) or i + 1 == len(words):
            continue
        a2, b2, w2 = words[i + 1]
        gap = plain[b:a2]
        pair = None
        if initial:
            if _INITIAL.match(gap) and maybe(w2) and (i == 0 or not (maybe(words[i - 1][2]) and _BETWEEN.match(plain[words[i - 1][1] : a]))):
                pair = (a, b2, "", w2)
        elif _BETWEEN.match(gap) and len(w2) == 1 and i + 2 < len(words):
            a3, b3, w3 = words[i + 2]
            if _INITIAL.match(plain[b2:a3]) and maybe(w3):
                pair = (a, b3, w, w3)
        elif _BETWEEN.match(gap) and maybe(w2):
            pair = (a, b2, w, w2)
        elif _COMMA.match(gap) and maybe(w2):
            pair = (a, b2, w2, w)
        if pair is None:
            continue
        s, e, g, f = pair
        if plain[s - 1 : s] not in ("@", "/") and plain[e : e + 1] != "@":
            found.append((s, e, g.casefold(), f.casefold()))
    return found


def _spans(bloom: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}

        def maybe(word: str) -> bool:
            hit = memo.get(word)
            if hit is None:
                if len(memo) > 300_000:
                    memo.clear()
                hit = memo[word] = len(word) > 1 and bloom_has(bloom, word.casefold())
            return hit

        for batch in batches:
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                plain, at, spans = detect(text)
                for kind, a, b in spans:
                    s, e = source_span(at, a, b, plain, text)
                    rows.append((k, kind, s, e, text[s:e], None, None, None))
                names = name_candidates(plain, maybe)
                taken = _Taken((a, b) for _, a, b in spans) if names else None
                for a, b, given, family in names:
                    if taken.free(a, b):
                        s, e = source_span(at, a, b, plain, text)
                        rows.append((k, "person", s, e, text[s:e], given, family, plain[a:b] == plain[a:b].lower()))
            cols = list(zip(*rows)) if rows else [[]] * 8
            ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], ["id", "pii_type", "start", "end", "pii_text", "given", "family", "small"])

    return run


def find_pii(df: DataFrame, parts: DataFrame, *, id: str, text: str) -> DataFrame:
    """(<id>, pii_type, start int, end int, pii_text): every passage of every text, offsets in code points.

    ``pii_text`` is text[start:end] as written, without labels, titles or markup. Types: email, phone, id_number (only
    where words of its clause say so), address (house number and street), person (given name or initial with family name).
    Null and empty texts have no passages; rows with one id are taken as they come, so equal rows give equal passages
    once. Two words that are everyday ones by their counts are no name where both stand in lower case. Without known name
    parts no names are reported. Whole texts are read.
    """
    kind = df.schema[id].dataType.simpleString()
    rows = spread(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "id")
    lexicon = name_lexicon(rows.select("text").filter("text is not null"), parts)
    spans = rows.mapInArrow(_spans(bloom_of(lexicon)), f"id {kind}, pii_type string, start int, end int, pii_text string, given string, family string, small boolean")
    part = lambda k: lexicon.filter(F.col("kind") == k).select(F.col("word").alias(k), F.col("is_everyday").alias(f"{k}_everyday"))
    initials = df.sparkSession.createDataFrame([("", False)], "given string, given_everyday boolean")
    told = spans.join(part("family"), "family", "left").join(part("given").unionByName(initials), "given", "left")
    told = told.filter("pii_type != 'person' or (family_everyday is not null and given_everyday is not null and not (small and family_everyday and given_everyday))")
    return told.select(F.col("id").alias(id), "pii_type", "start", "end", "pii_text").distinct()


def redact(df: DataFrame, parts: DataFrame, *, id: str, text: str) -> DataFrame:
    """df with the added columns redacted (text with [EMAIL], [PHONE], ... for each passage) and n_pii.

    ``id`` must tell texts apart. Passages that overlap are replaced as one, by the type of the first. A null text
    stays null. Columns of df with these names are replaced.
    """
    spans = find_pii(df, parts, id=id, text=text).groupBy(F.col(id).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "pii_type"))).alias("_spans"))
    kept = [c for c in df.columns if c not in ("redacted", "n_pii")]
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(id).alias("_key"), F.col(text).alias("_text"))
    joined = base.join(spans, F.col("_key") == F.col("_id"), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"), acc["n"].alias("n"))).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring("_text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["pii_type"]), F.lit("]")).alias("out"),
            (acc["n"] + 1).alias("n"),
        )
    )
    done = F.aggregate(F.coalesce("_spans", F.expr("array()").cast("array<struct<start:int,end:int,pii_type:string>>")), start, step)
    out = joined.withColumn("_done", done)
    return out.select("_row.*", F.when(F.col("_text").isNotNull(), F.concat("_done.out", F.substring("_text", F.col("_done.at") + 1, F.length("_text")))).alias("redacted"), F.col("_done.n").alias("n_pii"))
