"""Splits that keep related records together (problem 1): hash-to-min components, then weighted rendezvous hashing.

Records tied by a patient or a note get one split, directly or through others. Ids are compared without surrounding
white space and without one trailing ".0"; an id without a digit ties nothing. Notes shared by several patients are the
only links between patients, so the graph holds one star of edges for each such note and nothing else.

Every component, of whatever size, goes to the split with the least -ln(u) / weight, u a hash of (component, split) in
(0, 1): weighted rendezvous hashing. The shares are of rows, and components differ in size, so the weights are fitted:
they start at the shares and are moved until the rows that each split gets, counted over all components, miss the shares
by at most TOLERANCE of all rows (ROUNDS passes over (component, rows) at most, and only a sum a split comes to the
driver). One component that is larger than a split's share can make that impossible under one hash; then the next of
SEEDS hashes is taken, and if none will do, the nearest. As all weights are common to all components, rows that are
added move only the components that lie next to a border.

Defined results: null and placeholder ids tie nothing (a row with neither id is its own component); repeated rows stay;
an empty table gives an empty result; null or non-positive shares get nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

TOLERANCE = 0.002
ROUNDS = 8
SEEDS = 8
_STEPS = (0.3, 0.6, 1.0, 1.5, 2.2)


def clean_id(c: Column) -> Column:
    """The id as compared, or null where it ties nothing."""
    text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), r"\.0$", "")
    return F.when(text.rlike(r"\p{Nd}"), text)


def _ties(df: DataFrame, pat: str, note: str) -> DataFrame:
    return df.select(clean_id(F.col(pat)).alias("p"), clean_id(F.col(note)).alias("n")).where("p is not null and n is not null").distinct()


def patient_links(df: DataFrame, pat: str = "PAT_ID", note: str = "NOTE_ID") -> DataFrame:
    """Edges (a, b) from each note's least patient to its other patients."""
    ties = _ties(df, pat, note)
    shared = ties.groupBy("n").agg(F.min("p").alias("a"), F.max("p").alias("z")).where("a < z").select("n", "a")
    return ties.join(shared, "n").where("p <> a").select("a", F.col("p").alias("b")).distinct()


def related_patients(df: DataFrame, pat: str = "PAT_ID", note: str = "NOTE_ID") -> DataFrame:
    """(pat_a, pat_b), pat_a < pat_b: the pairs of patients in one component."""
    c = components(patient_links(df, pat, note))
    left, right = c.select("component", F.col("node").alias("pat_a")), c.select("component", F.col("node").alias("pat_b"))
    return left.join(right, "component").where("pat_a < pat_b").select("pat_a", "pat_b")


def row_components(df: DataFrame, key: str, pat: str = "PAT_ID", note: str = "NOTE_ID") -> DataFrame:
    """(key, component) of every row."""
    rows = df.select(F.col(key).alias("k"), clean_id(F.col(pat)).alias("p"), clean_id(F.col(note)).alias("n"))
    owner = rows.where("p is not null and n is not null").groupBy("n").agg(F.min("p").alias("owner"))
    orphans = rows.where("p is null").join(owner, "n", "left")
    known = rows.where("p is not null").select("k", "p").unionByName(orphans.where("owner is not null").select("k", F.col("owner").alias("p")))
    linked = known.join(components(patient_links(df, pat, note)), F.col("p") == F.col("node"), "left")
    named = linked.select("k", F.concat(F.lit("p:"), F.coalesce("component", "p")).alias("component"))
    alone = F.when(F.col("n").isNotNull(), F.concat(F.lit("n:"), F.col("n"))).otherwise(F.concat(F.lit("r:"), F.coalesce(F.col("k").cast("string"), F.lit(""))))
    rest = orphans.where("owner is null").select("k", alone.alias("component"))
    return named.unionByName(rest).withColumnRenamed("k", key)


def _draws(component: Column, names: list[str], seed: int) -> list[Column]:
    """-ln(u) of a component for each split."""
    u = lambda name: (F.xxhash64(component, F.lit(name), F.lit(seed)).cast("double") + F.lit(2.0**63) + F.lit(1024.0)) / F.lit(2.0**64 + 4096.0)
    return [-F.log(u(name)) for name in names]


def _nearest(draws: list[Column], weights: list[float]) -> Column:
    """The number of the split that a component goes to."""
    scored = [F.struct((d / F.lit(float(w))).alias("s"), F.lit(i).alias("i")) for i, (d, w) in enumerate(zip(draws, weights))]
    return (F.least(*scored) if len(scored) > 1 else scored[0])["i"]


def rendezvous(component: Column, shares: list[tuple[str, float]], seed: int) -> Column:
    """The split of a component by weighted rendezvous hashing."""
    have = [(name, w) for name, w in shares if w and w > 0]
    if not have:
        return F.lit(None).cast("string")
    at = _nearest(_draws(component, [name for name, _ in have], seed), [w for _, w in have])
    return F.element_at(F.array(*(F.lit(name) for name, _ in have)), at + 1)


def _rows_of(sizes: DataFrame, names: list[str], seed: int, tries: list[list[float]]) -> list[list[float]]:
    """The share of all rows that each split gets under each of some weights, in one pass."""
    drawn = sizes.select("n", *(d.alias(f"d{i}") for i, d in enumerate(_draws(F.col("component"), names, seed))))
    draws = [F.col(f"d{i}") for i in range(len(names))]
    dealt = drawn.select("n", *(_nearest(draws, w).alias(f"t{k}") for k, w in enumerate(tries)))
    sums = [F.sum(F.when(F.col(f"t{k}") == i, F.col("n")).otherwise(0)).alias(f"s{k}_{i}") for k in range(len(tries)) for i in range(len(names))]
    r = dealt.agg(F.sum("n").alias("n"), *sums).first()
    return [[r[f"s{k}_{i}"] / r["n"] for i in range(len(names))] for k in range(len(tries))]


def fit_weights(sizes: DataFrame, shares: dict[str, float], seed: int) -> tuple[list[tuple[str, float]], int, float]:
    """(weights, seed, largest miss): the weights under which the rows of (component, n) fall by the shares."""
    names, target = list(shares), list(shares.values())
    found: tuple[list[tuple[str, float]], int, float] | None = None
    for s in range(seed, seed + SEEDS):
        best, miss, got = target, 2.0, None
        tries = [target]
        for _ in range(ROUNDS):
            shared = _rows_of(sizes, names, s, tries)
            misses = [max(abs(x - t) for x, t in zip(row, target)) for row in shared]
            k = min(range(len(tries)), key=lambda j: misses[j])
            if misses[k] >= miss:
                break
            best, miss, got = tries[k], misses[k], shared[k]
            if miss <= TOLERANCE:
                break
            tries = [[w * ((t + 1e-4) / (x + 1e-4)) ** step for w, t, x in zip(best, target, got)] for step in _STEPS]
        if found is None or miss < found[2]:
            found = (list(zip(names, best)), s, miss)
        if miss <= 5 * TOLERANCE:
            break
    return found


def split(df: DataFrame, targets: DataFrame, key: str = "_run_row_index", pat: str = "PAT_ID", note: str = "NOTE_ID", seed: int = 17) -> DataFrame:
    """(key, component, split_name) of every row; targets has split_name and share."""
    from ..session import cut

    rows = cut(row_components(df, key, pat, note))
    shares = {r.split_name: max(0.0, r.share or 0.0) for r in targets.where("split_name is not null").orderBy("split_name").collect()}  # a few rows
    total = sum(shares.values())
    shares = {k: v / total for k, v in shares.items() if v > 0}
    if not shares:
        return rows.withColumn("split_name", F.lit(None).cast("string"))
    sizes = cut(rows.groupBy("component").agg(F.count("*").alias("n")))
    if sizes.isEmpty():
        return rows.withColumn("split_name", F.lit(None).cast("string"))
    weights, own, _ = fit_weights(sizes, shares, seed)
    return rows.withColumn("split_name", rendezvous(F.col("component"), weights, own))
