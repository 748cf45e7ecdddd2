"""Text functions as Columns: headers, names, sizes, missing tokens, counts in
descriptions and similarity of token-sorted texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

#: Texts that count as missing (fixed values).
MISSING = ("", "nan", "na", "n/a", "none", "null", ".")
#: Texts that say that no summary statistics exist (fixed values).
NO_SUMSTATS = ("", "na", "n/a", "nan", "none", "null", "no", "false", "0", "not available", "-")


def clean(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def is_missing(c: Column, tokens: tuple[str, ...] = MISSING) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*tokens)


def normal_header(c: Column) -> Column:
    """Lower case, without byte-order mark and brackets; separators become one
    underscore, none at the ends."""
    t = F.regexp_replace(F.lower(F.trim(c)), "[﻿\\[\\]]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[/:\-.\s]", "_"), "_+", "_"), F.lit("_"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")


def normal_url(c: Column) -> Column:
    """Trailing slashes off, ftp as https, no doubled slashes in the path."""
    t = F.regexp_replace(F.trim(c), "^(ftp|http)://", "https://")
    return F.regexp_replace(F.regexp_replace(t, "/+$", ""), "([^:])/{2,}", "$1/")


def parse_size(c: Column) -> Column:
    """12K, 3.4M and 1G as bytes."""
    number = F.regexp_extract(F.upper(F.trim(c)), r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(c)), r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B?$", 2)
    factor = F.when(unit == "K", 2.0**10).when(unit == "M", 2.0**20).when(unit == "G", 2.0**30).when(unit == "T", 2.0**40).otherwise(1.0)
    return F.floor(F.nullif(number, F.lit("")).try_cast("double") * factor).cast("long")


def count_before(c: Column, words: str) -> Column:
    """The number before a word of a description, such as `1,234 cases`."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(c), rf"([0-9][0-9,. ]*)[^0-9]{{0,40}}?\b(?:{words})\b", 1), "[,. ]", ""), F.lit("")).try_cast("long")


def has_phrase(c: Column, phrase: str) -> Column:
    return F.lower(c).rlike(rf"\b\Q{phrase.lower()}\E\b")


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda x: x != "")), " ")


def _ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = diagonal = 0
        for j, y in enumerate(b, 1):
            here = diagonal + 1 if x == y else max(row[j], left)
            diagonal, row[j], left = row[j], here, here
    return 200.0 * row[-1] / (len(a) + len(b))


def token_sort_ratio(c: Column, phrase: str) -> Column:
    """Similarity to a phrase, 0-100, of the sorted tokens, by the longest
    common subsequence: an Arrow batch at a time."""
    want = " ".join(sorted(phrase.lower().split()))

    @F.pandas_udf("double")
    def ratio(s: pd.Series) -> pd.Series:
        known = {v: _ratio(v, want) for v in s.dropna().unique()}
        return s.map(known).astype(float)

    return ratio(sorted_tokens(c))


def token_sort_distance(c: Column, phrase: str) -> Column:
    """The same with edit distance, all in the JVM."""
    a, b = sorted_tokens(c), F.lit(" ".join(sorted(phrase.lower().split())))
    return 100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))
