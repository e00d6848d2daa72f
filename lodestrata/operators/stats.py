"""Evaluation statistics (Q1-Q22) and sampling; a 0 denominator gives null, and nulls are left out of means."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType


def confusion(gold: Column, pred: Column) -> list[Column]:
    """Q1: tp, fp, fn, tn over rows whose labels are both Yes or No."""
    is_ = lambda c, v: c == v
    return [
        F.count_if(is_(gold, "Yes") & is_(pred, "Yes")).alias("tp"), F.count_if(is_(gold, "No") & is_(pred, "Yes")).alias("fp"),
        F.count_if(is_(gold, "Yes") & is_(pred, "No")).alias("fn"), F.count_if(is_(gold, "No") & is_(pred, "No")).alias("tn"),
    ]


def metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Q2: from counts."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    recall, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return {
        "precision": F.try_divide(tp, tp + fp), "recall": recall, "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "specificity": spec, "npv": F.try_divide(tn, tn + fn),
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (recall + spec) / 2,
        "mcc": F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def f1_from_rates(precision: Column, recall: Column) -> Column:
    """Null where both are 0."""
    return F.try_divide(2 * precision * recall, precision + recall)


def by_scope(df: DataFrame, scope: str, aggs: list[Column], total: str = "ALL") -> DataFrame:
    """Q3, Q16: each value of a scope and all together, in one pass."""
    return df.rollup(scope).agg(F.grouping(scope).alias("_g"), *aggs).withColumn(scope, F.when(F.col("_g") == 1, total).otherwise(F.col(scope))).drop("_g")


def holm(df: DataFrame, p: str, family: list[str], key: list[str]) -> DataFrame:
    """Q10: step-down adjusted p in each family; null p are left out."""
    kept = df.where(F.col(p).isNotNull())
    part = Window.partitionBy(*family)
    ranked = kept.withColumn("_m", F.count("*").over(part)).withColumn("_r", F.row_number().over(part.orderBy(p, *key)))
    run = F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(part.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_holm", F.least(F.lit(1.0), run)).drop("_m", "_r")


def mcnemar(b: Column, c: Column) -> Column:
    """Q11: exact two-sided p of b against c discordant pairs, null without any."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    # the logarithm of each term follows from the one before: log C(n, i + 1) = log C(n, i) + log((n - i) / (i + 1))
    first = F.struct((-n * math.log(2.0)).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] + F.log((n - i).cast("double") / (i + 1))).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), k), first, step)["sum"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def average_rank(order: str, part: list[str] | None = None) -> Column:
    """Q13: the mean of the ranks that equal values share."""
    w = Window.partitionBy(*(part or []))
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*(part or []), order)) - 1) / 2


def ranked(df: DataFrame, value: str, part: list[str], alias: str) -> DataFrame:
    """Q13 at scale: average ranks from the counts of distinct values, so that no task sorts a whole group's rows."""
    counts = df.groupBy(*part, value).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(alias, before + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*part, value])


def auroc(df: DataFrame, score: str, positive: str, part: list[str]) -> DataFrame:
    """Q13: (part, auroc, n_pos, n_neg), null if a class is absent; from the counts of distinct scores."""
    r = ranked(df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()), score, part, "_r")
    g = r.groupBy(*part).agg(F.sum(F.when(F.col(positive), F.col("_r"))).alias("s"), F.count_if(F.col(positive)).alias("n_pos"), F.count_if(~F.col(positive)).alias("n_neg"))
    u = F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return g.select(*part, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), u / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"), "n_pos", "n_neg")


def spearman(df: DataFrame, x: str, y: str, part: list[str]) -> DataFrame:
    """Q14: rank correlation, null below three rows or without spread."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = ranked(ranked(both, x, part, "_rx"), y, part, "_ry")
    g = r.groupBy(*part).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))
    return g.select(*part, "n", F.when((F.col("n") >= 3) & ~F.isnan("rho"), F.col("rho")).alias("rho"))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) of a standard normal, for which Spark has no function."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def mann_whitney(df: DataFrame, value: str, group: str, part: list[str]) -> DataFrame:
    """Q15: U of the rows where group holds, and the asymptotic two-sided p with correction for ties and continuity."""
    kept = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ties = kept.groupBy(*part, value).agg(F.count("*").alias("t")).groupBy(*part).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    r = ranked(kept, value, part, "_r").groupBy(*part).agg(F.sum(F.when(F.col(group), F.col("_r"))).alias("s"), F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n2"))
    g = (r.join(ties, part) if part else r.crossJoin(ties)).withColumn("u", F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5), sd)
    return g.select(*part, "n1", "n2", "u", z.alias("z")).withColumn("p", normal_two_sided("z"))


def bootstrap_weights(spark: SparkSession, units: list, reps: int, seed: int = 42) -> DataFrame:
    """Q6, Q7 with a generator of the driver's: (rep, unit, w), the times a unit is drawn; units of a bounded list."""
    draws = np.random.default_rng(seed).multinomial(len(units), [1 / len(units)] * len(units), size=reps)
    rep, at = np.nonzero(draws)
    frame = pd.DataFrame({"rep": rep.astype("int32"), "unit": [units[i] for i in at], "w": draws[rep, at].astype("int32")})
    return spark.createDataFrame(frame)


#: Chances that a Poisson variable of mean 1 is at most 0, 1, ... 12.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])


def hashed_weights(units: np.ndarray, reps: np.ndarray, seed: int = 42) -> np.ndarray:
    """(reps, units): how often a unit, given by a 64-bit hash, is drawn in a replicate; Poisson of mean 1, without a period."""
    with np.errstate(over="ignore"):
        z = units.astype(np.uint64)[None, :] + (reps.astype(np.uint64)[:, None] + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(times)
    return np.searchsorted(_POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")


def bootstrap_hashed(counts: DataFrame, unit: str, part: str, cols: list[str], reps: int, block: int = 128) -> DataFrame:
    """Q6, Q7 at the reference's number of replicates: (rep, part, cols), the counts of units of any id weighted and summed.

    A batch of rows is one matrix product a block of replicates, so reps rows a part and batch are shuffled."""
    kind = counts.schema[part].dataType.simpleString()

    def run(batches):
        for b in batches:
            f = b.to_pandas()
            for name, g in f.groupby("part", dropna=False):
                h, v = g["unit"].to_numpy(np.int64).view(np.uint64), g[cols].to_numpy(np.float64)
                for at in range(0, reps, block):
                    r = np.arange(at, min(at + block, reps))
                    s = hashed_weights(h, r) @ v
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array([name] * len(r), b.schema.field("part").type), *(pa.array(s[:, i].round().astype(np.int64)) for i in range(len(cols)))], names=["rep", part, *cols])

    rows = counts.select(F.xxhash64(unit).alias("unit"), F.col(part).alias("part"), *cols)
    sums = rows.mapInArrow(run, f"rep int, {part} {kind}, " + ", ".join(f"{c} bigint" for c in cols))
    return sums.groupBy("rep", part).agg(*(F.sum(c).alias(c) for c in cols))


def percentile_ci(c: Column, low: float = 0.025, high: float = 0.975) -> Column:
    """Q8: linear interpolation; nulls are left out."""
    return F.percentile(c, F.array(F.lit(low), F.lit(high)))


def bootstrap_p(delta: Column) -> Column:
    """Q9: an aggregate over the replicates' differences."""
    n = F.count(delta)
    return F.least(F.lit(1.0), 2 * F.least((F.count_if(delta <= 0) + 1) / (n + 1), (F.count_if(delta >= 0) + 1) / (n + 1)))


def stratified(df: DataFrame, stratum: list[str], n: int, order: list[Column]) -> DataFrame:
    """Q21: exactly n rows of each stratum (all, if fewer), the first in the given order."""
    w = Window.partitionBy(*stratum).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def paired_keys_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Q12: keys that only one of two systems has; empty if they can be compared."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).unionByName(y.exceptAll(x))


def run_scores(df: DataFrame, scope: str, gold: str, pred: str) -> DataFrame:
    """One row for a run: pairs, coverage, macro means (scopes without a value left out), F1 weighted by support,
    Hamming loss, micro F1, and the macro mean of F1 from rates."""
    f = df.groupBy(scope).agg(*confusion(F.col(gold), F.col(pred)), F.count("*").alias("pairs"), F.count(pred).alias("n"))
    m = metrics(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))
    d = f.select("*", m["precision"].alias("p"), m["recall"].alias("r"), m["f1"].alias("f"), f1_from_rates(m["precision"], m["recall"]).alias("f2"), (F.col("tp") + F.col("fn")).alias("support"))
    total = F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return d.agg(
        F.sum("pairs").alias("pairs"), F.try_divide(F.sum("n"), F.sum("pairs")).alias("coverage"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f") * F.col("support")), F.sum("support")).alias("weighted_f1"), (1 - F.try_divide(F.sum(F.col("tp") + F.col("tn")), total)).alias("hamming_loss"),
        F.try_divide(2 * F.sum("tp"), F.sum(2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("micro_f1"), F.avg("f2").alias("macro_f1_of_rates"),
    )


#: Sixteen-bit draws below these give a weight of 0, 1, ... 7: a Poisson variable of mean 1.
THRESHOLDS = tuple(int(x) for x in np.floor(_POISSON[:8] * 65536))


def digest_weights(units: list[str], reps: int) -> np.ndarray:
    """(units, reps): how often a unit is drawn in each replicate: sixteen bits of the MD5 digest of unit/k, eight
    replicates from each digest; independent of one another and the same in any engine."""
    from hashlib import md5

    raw = b"".join(md5(f"{u}/{k}".encode()).digest() for u in units for k in range(-(-reps // 8)))
    draws = np.frombuffer(raw, ">u2").reshape(len(units), -1)[:, :reps]
    return np.searchsorted(np.asarray(THRESHOLDS), draws, side="right")


def bootstrap_digest(counts: DataFrame, unit: str, part: str, cols: list[str], reps: int, block: int = 500) -> DataFrame:
    """Q6, Q7: (rep, part, cols): the counts of units weighted and summed in each replicate. A batch of units is one matrix
    product a block of them, so a part has reps rows a batch in the shuffle, not reps rows a unit."""
    kind = counts.schema[part].dataType.simpleString()

    def run(batches):
        for b in batches:
            f = b.to_pandas()
            for name, g in f.groupby("part", dropna=False):
                total = np.zeros((reps, len(cols)), np.int64)
                for at in range(0, len(g), block):
                    some = g.iloc[at : at + block]
                    total += digest_weights(some["unit"].tolist(), reps).T @ some[cols].to_numpy(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps), pa.int32()), pa.array([name] * reps, b.schema.field("part").type), *(pa.array(total[:, i]) for i in range(len(cols)))], names=["rep", part, *cols])

    rows = counts.select(F.col(unit).cast("string").alias("unit"), F.col(part).alias("part"), *cols)
    sums = rows.mapInArrow(run, f"rep int, {part} {kind}, " + ", ".join(f"{c} bigint" for c in cols))
    return sums.groupBy("rep", part).agg(*(F.sum(c).alias(c) for c in cols))


def all_deltas(df: DataFrame, gold: str, systems: tuple[str, ...]) -> DataFrame:
    """Q12: (a, b, n, accuracy, f1): b less a over the rows both have, for every two systems, in one pass."""
    pairs = [(a, b) for i, a in enumerate(systems) for b in systems[i + 1 :]]
    ok = lambda s: (F.col(s) == F.col(gold)).cast("int")
    yes = lambda s: F.col(s) == "Yes"
    out = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        n = lambda c, w=both: F.count_if(w & c)
        f1 = lambda s, w=both: F.try_divide(2 * F.count_if(w & yes(gold) & yes(s)).cast("double"), F.count_if(w & yes(gold)) + F.count_if(w & yes(s)))
        mean = lambda s, w=both: F.avg(F.when(w, ok(s)))
        out.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n(F.lit(True)).alias("n"), (mean(b) - mean(a)).alias("accuracy"), (f1(b) - f1(a)).alias("f1")))
    return df.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def judge_summary(df: DataFrame, scope: str, gold: str, label: str, in_note: str, faithfulness: str, support: str) -> DataFrame:
    """Q17: a judge's scores by scope and all, and by whether a positive is right (TP), wrong (FP) or either; a pair
    without gold counts as wrong."""
    right = F.coalesce((F.col(gold) == "Yes") & (F.col(label) == "Yes"), F.lit(False))
    x = df.withColumn("correctness", F.explode(F.array(F.lit("ALL"), F.when(right, "TP").otherwise("FP")))).withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col(scope))))
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    return x.groupBy("scope", "correctness").agg(
        F.count("*").alias("n"), rate(F.col(in_note)).alias("evidence_in_note"), F.round(F.avg(faithfulness), 6).alias("faithfulness"), rate(F.col(faithfulness) >= 4).alias("faithfulness_4_5"),
        F.round(F.avg(support), 6).alias("support"), rate(F.col(support) >= 4).alias("support_4_5"), rate(F.col(support) <= 2).alias("support_1_2"),
    )


def recovery_gates(df: DataFrame, gold: str, current: str, overlay: str, least_recall: float = 0.73, least_precision: float = 0.84) -> DataFrame:
    """Q20: how many recoveries were accepted, right and wrong, and whether recall and precision reach their goals and F1
    and MCC rise."""
    counts = lambda s, x: [c.alias(n + x) for c, n in zip(confusion(F.col(gold), F.col(s)), ("tp", "fp", "fn", "tn"))]
    new = (F.col(current) == "No") & (F.col(overlay) == "Yes")
    d = df.agg(
        *counts(current, "a"), *counts(overlay, "b"), F.count_if(new).alias("accepted"), F.count_if(new & (F.col(gold) == "Yes")).alias("tp_recovered"), F.count_if(new & (F.col(gold) == "No")).alias("fp_added")
    )
    a, b = (metrics(*(F.col(n + x) for n in ("tp", "fp", "fn", "tn"))) for x in "ab")
    gates = {"recall_ge_073": b["recall"] >= least_recall, "precision_ge_084": b["precision"] >= least_precision, "f1_gt_current": b["f1"] > a["f1"], "mcc_gt_current": b["mcc"] > a["mcc"]}
    return d.select("accepted", "tp_recovered", "fp_added", *(c.alias(k) for k, c in gates.items()))


def design(df: DataFrame, scope: str, gold: str, changed: str, shared: str, order: list[Column], each: int = 50, errors: int = 100) -> DataFrame:
    """Q21: flags of three sets: ``each`` rows of a scope at its observed prevalence, all changed rows, and ``errors`` of
    the shared errors; exact numbers, the first in the given order."""
    share = F.round(F.avg((F.col(gold) == "Yes").cast("int")).over(Window.partitionBy(scope)) * each)
    rank = F.row_number().over(Window.partitionBy(scope, gold).orderBy(*order))
    # only the first of each bucket can be among the first of all, so no task ranks all shared errors
    bucket = Window.partitionBy("_b", shared).orderBy(*order)
    d = df.withColumn("_pos", share).withColumn("_rn", rank).withColumn("_b", F.pmod(F.xxhash64(*df.columns), F.lit(64))).withColumn("_rb", F.row_number().over(bucket))
    first = F.row_number().over(Window.partitionBy(F.col(shared) & (F.col("_rb") <= errors)).orderBy(*order))
    few = d.where(F.col(shared) & (F.col("_rb") <= errors)).withColumn("_rs", first)
    rest = d.where(~(F.col(shared) & (F.col("_rb") <= errors))).withColumn("_rs", F.lit(errors + 1))
    both = few.unionByName(rest)
    quota = F.when(F.col(gold) == "Yes", F.col("_pos")).otherwise(each - F.col("_pos"))
    flags = {"in_representative": F.col("_rn") <= quota, "in_changed": F.col(changed), "in_shared": F.col(shared) & (F.col("_rs") <= errors)}
    return both.select(*df.columns, *(c.alias(k) for k, c in flags.items()))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def student_two_sided(t: float, n: float) -> float:
    """P(|T| >= |t|) of Student's distribution with n degrees of freedom."""
    x, a, b = n / (n + t * t), n / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Q14: the two-sided p of a rank correlation, by the t distribution; a row a group."""
    return pd.Series([None if r is None or r != r or k < 3 else 0.0 if abs(r) >= 1 else student_two_sided(r * math.sqrt((k - 2) / (1 - r * r)), k - 2) for r, k in zip(rho, n)], dtype="float64")
