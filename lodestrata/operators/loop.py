"""Claims, verdicts, the bounded verify-refine loop and the judge."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V

MAX_ROUNDS = 5


def verdict(issues: Column) -> Column:
    return F.when(F.size(issues) > 0, "REFINE").otherwise("VERIFIED")


def change_type(before: Column, after: Column, evidence_changed: Column, metadata_changed: Column, error: Column) -> Column:
    """V5: an error first, then a changed label by its direction, then changed evidence, then changed fields."""
    return (
        F.when(F.coalesce(error, F.lit(False)), "REFINEMENT_ERROR").when((before == "Yes") & (after == "No"), "REJECTED").when((before == "No") & (after == "Yes"), "RECOVERED")
        .when(~before.eqNullSafe(after), "LABEL_CHANGED").when(evidence_changed, "EVIDENCE_CORRECTED").when(metadata_changed, "METADATA_CORRECTED").otherwise("CONFIRMED")
    )


def fold_rounds(initial: Column, label: Column, rounds: Column, bound: int = MAX_ROUNDS, reverify: bool = True, refine: bool = True, made: int = 0) -> Column:
    """The loop as one fold over the rounds that were, or would be, made.

    initial: the verdict on the first claim; rounds: array of struct(label, verdict, error) in order. The result is a
    struct(exit_reason, label, rounds, flips, labels, done). A round is counted when it is refined; an error keeps the
    claim; an unchanged label ends the loop without another look; a verified one ends it; after ``bound`` rounds a claim
    still to be refined oscillates. reverify and refine switch those parts off. A stored state is carried on by
    folding what follows its last label, with the rounds ``made`` so far and a higher bound."""
    start = F.struct(
        F.when(initial == "VERIFIED", "VERIFIED").when(initial.isNull() | (initial != "REFINE"), "INVALID_INITIAL_VERIFIER_STATE")
        .otherwise(F.lit(None).cast("string") if refine else F.lit("REFINER_ABLATED")).alias("exit_reason"),
        label.alias("label"), F.lit(made).alias("rounds"), F.lit(0).alias("flips"), F.array(label).alias("labels"),
    )

    def step(s: Column, r: Column) -> Column:
        n = s["rounds"] + 1
        changed = r["label"] != s["label"]
        failed = F.coalesce(r["error"], F.lit(False))
        exit_ = (
            F.when(failed, "REFINEMENT_ERROR")
            .when(~changed, "LABEL_STABLE")
            .when(F.lit(not reverify), "NO_REVERIFICATION")
            .when((r["verdict"] == "VERIFIED") & (n >= bound), "MAX_ROUNDS_FINAL_VERIFIED")
            .when(r["verdict"] == "VERIFIED", "VERIFIED")
            .when(r["verdict"].isNull() | (r["verdict"] != "REFINE"), F.when(n >= bound, "MAX_ROUNDS_FINAL_VERIFICATION_ERROR").otherwise("INVALID_REVERIFICATION_STATE"))
            .when(n >= bound, "MAX_ROUNDS_LABEL_OSCILLATION")
        )
        new = F.struct(
            exit_.alias("exit_reason"), F.when(failed, s["label"]).otherwise(r["label"]).alias("label"), n.alias("rounds"),
            (s["flips"] + F.when(~failed & changed, 1).otherwise(0)).alias("flips"), F.when(failed, s["labels"]).otherwise(F.concat(s["labels"], F.array(r["label"]))).alias("labels"),
        )
        return F.when(s["exit_reason"].isNotNull(), s).otherwise(new)

    return F.aggregate(F.coalesce(rounds, F.array().cast("array<struct<label:string,verdict:string,error:boolean>>")), start, step)


class Backend(Protocol):
    """What stands for a text generator: proposals for the rows it is given, one each, with the same keys."""

    def propose(self, claims: DataFrame) -> DataFrame: ...


class TableBackend:
    """Proposals looked up in a table; deterministic, so that every query can be tested without a model."""

    def __init__(self, answers: DataFrame, keys: list[str]) -> None:
        self.answers, self.keys = answers, keys

    def propose(self, claims: DataFrame) -> DataFrame:
        return claims.join(self.answers, self.keys, "left")


def run_live(claims: DataFrame, backend: Backend, bound: int = MAX_ROUNDS) -> DataFrame:
    """V7 with a backend: at most ``bound`` stages, each on the claims still open; every stage is cut by a checkpoint.

    claims: key columns, label, verdict. The backend adds new_label, new_verdict, error for the claim and round."""
    from ..session import cut

    keep = [c for c in claims.columns if c not in ("label", "verdict")]
    open_ = claims.withColumn("exit_reason", F.when(F.col("verdict") == "VERIFIED", "VERIFIED").when(F.coalesce(F.col("verdict") != "REFINE", F.lit(True)), "INVALID_INITIAL_VERIFIER_STATE")).withColumn("rounds", F.lit(0))
    done = open_.where("exit_reason is not null").select(*keep, "label", "exit_reason", "rounds")
    open_ = open_.where("exit_reason is null").select(*keep, "label", "rounds")
    for n in range(1, bound + 1):
        made = cut(backend.propose(open_.withColumn("round", F.lit(n))))
        failed, same = F.coalesce(F.col("error"), F.lit(False)), F.col("new_label") == F.col("label")
        ok = F.col("new_verdict") == "VERIFIED"
        exit_ = (
            F.when(failed, "REFINEMENT_ERROR").when(same, "LABEL_STABLE").when(ok, "MAX_ROUNDS_FINAL_VERIFIED" if n == bound else "VERIFIED")
            .when(F.coalesce(F.col("new_verdict") != "REFINE", F.lit(True)), "MAX_ROUNDS_FINAL_VERIFICATION_ERROR" if n == bound else "INVALID_REVERIFICATION_STATE")
        )
        if n == bound:
            exit_ = F.coalesce(exit_, F.lit("MAX_ROUNDS_LABEL_OSCILLATION"))
        step = made.withColumn("exit_reason", exit_).withColumn("label", F.when(failed, F.col("label")).otherwise(F.col("new_label"))).withColumn("rounds", F.lit(n))
        done = done.unionByName(step.where("exit_reason is not null").select(*keep, "label", "exit_reason", "rounds"))
        open_ = step.where("exit_reason is null").select(*keep, "label", "rounds")
    return done


def review_needed(exit_reason: Column, *flags: Column) -> Column:
    """An unresolved exit, or any flag."""
    out = exit_reason.isin("MAX_ROUNDS_LABEL_OSCILLATION", "MAX_ROUNDS_FINAL_VERIFICATION_ERROR", "REFINEMENT_ERROR")
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return F.coalesce(out, F.lit(False))


def change_quality(gold: Column, before: Column, after: Column) -> Column:
    """Corrective, degrading, other or none."""
    return F.when(before == after, "none").when((after == gold) & (before != gold), "corrective").when((before == gold) & (after != gold), "degrading").otherwise("other")


def merge_reasons(judge: Column, forced: Column) -> Column:
    """Reasons are added and never cleared."""
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(judge, F.array().cast("array<string>")), F.coalesce(forced, F.array().cast("array<string>")))))


def verdict_change(before: Column, after: Column) -> Column:
    """Q22."""
    rank = lambda c: F.when(c == "VERIFIED", 1).when(c == "REFINE", 0)
    return F.when(rank(after) > rank(before), "IMPROVED").when(rank(after) < rank(before), "DEGRADED").otherwise("UNCHANGED")


def wide_to_claims(df: DataFrame, keys: list[str], features: tuple[str, ...] = V.FINDINGS, fields: tuple[str, ...] = ("label", "confidence")) -> DataFrame:
    """One row for each note and finding from columns named "feature field"."""
    parts = [F.struct(F.lit(f).alias("feature"), *(F.col(f"{f} {x}").cast("string").alias(x) for x in fields)) for f in features]
    return df.select(*keys, F.explode(F.array(*parts)).alias("c")).select(*keys, "c.*")


def claims_to_wide(df: DataFrame, keys: list[str], value: str, features: tuple[str, ...] = V.FINDINGS) -> DataFrame:
    """A column for each finding; the least value where a pair repeats."""
    return df.groupBy(*keys).pivot("feature", list(features)).agg(F.min(value))


def first_text(*cs: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in cs))


def adopt_best(attempts: Column) -> Column:
    """Of attempts struct(label, score) in order, the last that bettered the best so far."""
    first = F.struct(F.lit(None).cast("string").alias("label"), F.lit(-1.0).alias("score"))
    return F.aggregate(attempts, first, lambda s, a: F.when(a["score"] > s["score"], F.struct(a["label"].alias("label"), a["score"].alias("score"))).otherwise(s))
