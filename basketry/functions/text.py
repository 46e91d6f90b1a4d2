"""Unicode compatibility forms, as column expressions. Texts of ASCII alone, which have one form only, are passed through."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NOT_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=1)
def _table() -> tuple[str, str, list[tuple[str, str]]]:
    """By a rule from Python's Unicode data: characters that become one of ASCII, what they become, and those that become several."""
    one, several = [], []
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        new = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if new:
            (one if len(new) == 1 else several).append((c, new))
    return "".join(a for a, _ in one), "".join(b for _, b in one), several


def to_ascii(c: Column) -> Column:
    """Compatibility decomposition (NFKD) without what isn't ASCII: letters lose accents, ligatures become letters, others go."""
    old, new, several = _table()
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several))
    # Few texts have a character that becomes several; only those are folded over.
    folded = F.aggregate(F.filter(pairs, lambda p: F.contains(c, p["a"])), c, lambda s, p: F.replace(s, p["a"], p["b"]))
    whole = F.when(c.rlike("[" + "".join(re.escape(a) for a, _ in several) + "]"), folded).otherwise(c)
    return F.when(c.rlike(NOT_ASCII), F.regexp_replace(F.translate(whole, old, new), NOT_ASCII, "")).otherwise(c)


def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def compatible(c: Column) -> Column:
    """Compatibility composition (NFKC) of the whole text, letters and marks that stand apart included. No expression of Spark composes them, so texts that aren't ASCII go to Python in Arrow batches; of others only a null does."""
    other = c.rlike(NOT_ASCII)
    return F.when(other, F.pandas_udf(_normalized, StringType())(F.when(other, c))).otherwise(c)
