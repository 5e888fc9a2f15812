"""Text functions: words, tokens and a Porter stemmer. Everything but the stemmer runs in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.values import folded, nfkd

# The words that carry no meaning of their own.
STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can could
did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is
it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so
some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what
when where which while who whom why will with would you your yours yourself yourselves s t don isn wasn doesn didn won ll ve re d m o y
what's whats""".split()
)

WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"


def _combining() -> str:
    """A class of all characters with a canonical combining class, of which only marks have one."""
    marks = [c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    edges = [(a, b) for a, b in zip([None, *marks], [*marks, None]) if a is None or b is None or b > a + 1]
    spans = zip([b for _, b in edges[:-1]], [a for a, _ in edges[1:]])
    # Most characters are no marks at all, which is quicker to see.
    return r"(?:(?=[\p{M}\p{Cn}])[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "])+"


COMBINING = _combining()


def normalized(col: Column) -> Column:
    """Folded case without accents: compatibility decomposition, combining marks dropped, full case folding."""
    return folded(F.regexp_replace(nfkd(col), COMBINING, ""))


def words_of(norm: Column) -> Column:
    """Words of a normalized text: letters and digits with one inner apostrophe; a closing 's and apostrophes are dropped."""
    bare = F.transform(F.regexp_extract_all(norm, F.lit(WORD), F.lit(0)), lambda w: F.when(w.contains("'") | w.contains("’"), F.regexp_replace(F.regexp_replace(w, "['’]s$", ""), "['’]", "")).otherwise(w))
    return F.filter(bare, lambda w: w != "")


def content_words(words: Column) -> Column:
    """Words that are no stop words, in order and with repetitions."""
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def with_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """df with the unstemmed tokens of a text column. A null text has none (an empty array)."""
    return df.withColumn("_norm", normalized(F.coalesce(F.col(text), F.lit("")))).withColumn(out, content_words(words_of(F.col("_norm")))).drop("_norm")


def _cons(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and _cons(w, i - 1))


def _shape(w: str) -> str:
    """c and v for each letter."""
    return "".join("c" if _cons(w, i) else "v" for i in range(len(w)))


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _short(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix pairs of Porter's steps 2 to 4, with the two later rules for bli and logi.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _endings(w: str, table) -> list[str]:
    """The suffixes of a table that a word ends in, the longest first."""
    return sorted((s for s in table if w.endswith(s)), key=len, reverse=True)


def porter_stem(w: str) -> str:
    """The stem of a lower-case word by Porter's rules; short words, words with digits and others than ASCII stay."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short(cut)):
            w = cut + "e"
        elif _doubled(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = next((s for s in _endings(w, table) if _measure(w[: -len(s)]) > 0), None)
        if s:
            w = w[: -len(s)] + table[s]
    s = next(iter(_endings(w, _STEP4)), None)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem_udf(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    memo: dict[str, str] = {}
    for s in words:
        yield s.map(lambda w: None if w is None else memo[w] if w in memo else memo.setdefault(w, porter_stem(w)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all_udf(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of arrays that have to stay arrays; each task works out a word once."""
    memo: dict[str, str] = {}
    for s in lists:
        yield s.map(lambda ws: None if ws is None else [memo[w] if w in memo else memo.setdefault(w, porter_stem(w)) for w in ws])


def stemmed(postings: DataFrame, term: str = "term") -> DataFrame:
    """postings with each term replaced by its stem; the stemmer sees every different term once."""
    vocabulary = postings.select(term).distinct().withColumn("_stem", stem_udf(F.col(term)))
    return postings.join(vocabulary, term).drop(term).withColumnRenamed("_stem", term)


def register(spark) -> None:
    """porter_stem for SQL."""
    spark.udf.register("porter_stem", stem_udf)
