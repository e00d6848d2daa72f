"""Normalisers and predicates (N1-N14, G1, H2, H5) as Column expressions; nulls stay null unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V


def normalize_id(c: Column, digits_only: bool = False) -> Column:
    """Trimmed text without a trailing ".0"; digits_only strips it from all-digit ids alone."""
    t = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(t, r"^(\d+)\.0$" if digits_only else r"^(.*)\.0$", "$1")


def norm_feature(c: Column) -> Column:
    """Lower case, underscores and runs of space as one space."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "_", " "), r"(?U)\s+", " ")))


def label(c: Column, signs: bool = False, strict: bool = False) -> Column:
    """Yes / No or null (strict: an error); signs adds positive and negative."""
    t = F.lower(F.trim(c))
    yes = [*V.YES_LABELS] + (["positive"] if signs else [])
    no = [*V.NO_LABELS] + (["negative"] if signs else [])
    out = F.when(t.isin(yes), "Yes").when(t.isin(no), "No")
    return out.otherwise(F.raise_error(F.concat(F.lit("no label: "), F.coalesce(c, F.lit("null"))))) if strict else out


def tri_bool(c: Column) -> Column:
    """True, false or null from text; never a cast, which fails on other words."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def safe_bool(c: Column) -> Column:
    """As tri_bool, all else false."""
    return F.coalesce(tri_bool(c), F.lit(False))


def first_number(c: Column) -> Column:
    """The first decimal number in a text."""
    return F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def confidence(c: Column, strict: bool = False) -> Column:
    """A whole number from 1 to 5, else null (strict: an error)."""
    n = c.try_cast("double")
    ok = (n == F.floor(n)) & n.between(1, 5)
    return F.when(ok, n.cast("int")).otherwise(F.raise_error(F.lit("confidence out of 1 to 5"))) if strict else F.when(ok, n.cast("int"))


_QUOTES = ("“”‘’", "\"\"''")


def fold_text(c: Column) -> Column:
    """N7 without decomposition: lower case, straight quotes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), *_QUOTES), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, for which Spark has no function."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def normalize_text(c: Column) -> Column:
    """Only texts that are not plain ASCII go through Python."""
    return fold_text(F.when(c.rlike(r"[^\x00-\x7F]"), nfkd(c)).otherwise(c))


def usable_inference(c: Column, stop: tuple[str, ...] = V.STOP_VALUES, least: int = 5, prefixes: tuple[str, ...] = V.STOP_PREFIXES) -> Column:
    """Longer than ``least``, no stop value, no stop prefix."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = (F.length(t) > least) & ~t.isin(*stop)
    for p in prefixes:
        out = out & ~t.startswith(p)
    return out


def no_quotation(c: Column) -> Column:
    """Blank, or one of the inferences that are no quotation."""
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*V.BAD_INFERENCE)


def strip(c: Column) -> Column:
    """A text without white space of any script around it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def usable_quote(c: Column, least: int = 5) -> Column:
    """More than ``least`` characters that are no white space."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")) > least


def truncate_middle(c: Column, limit: int, mark: str = "\n...\n") -> Column:
    """Both ends of a text above the limit."""
    half = limit // 2
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, half), F.lit(mark), F.right(c, F.lit(half))))


def truncate_right(c: Column, limit: int, mark: str = " [cut]") -> Column:
    """The beginning and a mark, ``limit`` characters in all."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - len(mark)), F.lit(mark)))


def tokens(c: Column) -> Column:
    """G1: runs of letters, digits and underscores, and single other characters, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))


def clean(c: Column) -> Column:
    """H2: trimmed, null as empty."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))
