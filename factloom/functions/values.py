"""Column functions for comparing recorded values, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(col: Column) -> Column:
    """Canonical composition; null stays null. Uses the ICU library that Spark ships with."""
    made = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(col, F.lit("")), F.lit(False))
    return F.when(col.isNotNull(), made)


def nfkd(col: Column) -> Column:
    """Compatibility decomposition; null stays null."""
    made = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(col, F.lit("")), F.lit(True))
    return F.when(col.isNotNull(), made)


def folded(col: Column) -> Column:
    """Full case folding; null stays null."""
    made = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.coalesce(col, F.lit("")), F.lit(True))
    return F.when(col.isNotNull(), made)


def value_key(composed: Column) -> Column:
    """What two spellings of one value share: no case, remarks in parentheses, spare white space or closing period.

    ``composed`` must already be in canonical composition (see ``nfc``).
    """
    bare = F.regexp_replace(F.lower(composed), r"\([^()]*\)", " ")
    bare = F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(bare, r"[\s.]+$", ""))
