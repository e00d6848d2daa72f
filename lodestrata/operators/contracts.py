"""Join and value contracts (J1-J13, H3, H4): violations as rows, or strict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def full_outer(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Both sides with an indicator both, left or right; shared names get suffixes."""
    shared = (set(a.columns) & set(b.columns)) - set(keys)
    x = a.select(*keys, *(F.col(c).alias(c + suffixes[0] if c in shared else c) for c in a.columns if c not in keys), F.lit(True).alias("_in_a"))
    y = b.select(*keys, *(F.col(c).alias(c + suffixes[1] if c in shared else c) for c in b.columns if c not in keys), F.lit(True).alias("_in_b"))
    side = F.when(F.col("_in_a") & F.col("_in_b"), "both").when(F.col("_in_a"), "left").otherwise("right")
    return x.join(y, keys, "full").withColumn("side", side).drop("_in_a", "_in_b")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(value).alias("values")).where("values > 1")


def agreed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key, keys in conflict left out."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_max"))
    return g.where(F.col(value) == F.col("_max")).drop("_max")


def incomplete(df: DataFrame, unit: str, feature: str, features: tuple[str, ...]) -> DataFrame:
    """Units that lack a feature, or have another."""
    got = df.groupBy(unit).agg(F.array_sort(F.collect_set(feature)).alias("got"), F.count("*").alias("n"))
    return got.where(F.col("got") != F.array(*map(F.lit, sorted(features))))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def member_flags(df: DataFrame, keys: list[str], sets: dict[str, DataFrame]) -> DataFrame:
    """Rows of any of the sets, with a flag for each."""
    out = df
    for name, s in sets.items():
        out = out.join(s.select(*keys).distinct().withColumn(f"in_{name}", F.lit(True)), keys, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    any_ = F.lit(False)
    for name in sets:
        any_ = any_ | F.col(f"in_{name}")
    return out.where(any_)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """H3."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """H4: the first candidate among the columns, whatever the case, hyphens and spaces as underscores."""
    fold = lambda s: s.strip().lower().replace("-", "_").replace(" ", "_")
    by = {fold(c): c for c in reversed(df.columns)}
    return next((by[fold(c)] for c in candidates if fold(c) in by), None)


def last_before(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = 1_000_000) -> DataFrame:
    """The last value that is not null among a key's rows before this one, by a whole number that orders them.

    A key may hold a third of all rows, so its rows are cut into ranges of the order: the last value of each range is made
    by partial aggregation and carried over the few ranges of a key, and only rows of one range are sorted by one task."""
    d = df.withColumn("_range", F.floor(F.col(order) / width))
    own = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy(*keys, "_range").agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    carried = ranges.withColumn("_carried", F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_range")]
    j = d.withColumn("_near", F.last(value, ignorenulls=True).over(own)).alias("d").join(carried.alias("c"), same, "left")
    return j.select("d.*", F.coalesce("d._near", "c._carried").alias(out)).drop("_range", "_near")
