"""The recovery scan, guards of the refiner, evidence profiles and query wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import policy as P
from ..functions import structure as S
from ..functions.normalize import fold_text
from . import text as T


def candidates(notes: DataFrame, key: str, text: str, aliases: dict[str, tuple[str, ...]], keep: int = 3) -> DataFrame:
    """(key, feature, alias, start, end, quote, ord): the first ``keep`` eligible mentions of a finding in a note, one
    for each wording of their surroundings."""
    m = T.mentions(notes, key, text, aliases, 140, 140)
    m = m.where(S.eligible_in(F.col("feature"), F.col("before"), F.col("alias"), F.col("after"))).withColumn("quote", S.quote_in(F.col("before"), F.col("alias"), F.col("after"))).drop("before", "after")
    one = Window.partitionBy(key, "feature", fold_text(F.col("quote"))).orderBy("start")
    order = Window.partitionBy(key, "feature").orderBy("start")
    return m.withColumn("_rn", F.row_number().over(one)).where("_rn = 1").drop("_rn").withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= keep)


def recovery_scan(notes: DataFrame, key: str, text: str, aliases: dict[str, tuple[str, ...]], keep: int = 3) -> tuple[DataFrame, DataFrame]:
    """(accepted, audit). The first ``keep`` eligible mentions of a finding in a note, one for each wording of
    their surroundings, are tried in order; the first without a failure is accepted, the audit goes up to it."""
    low = notes.select(F.col(key), F.lower(text).alias("_t")).where("_t is not null")
    c = candidates(low, key, "_t", aliases, keep)
    c = c.join(low, key)  # the text only for the few mentions that are tried
    c = S.structural_failures(c, "feature", "alias", "quote", "_t", "_structural").withColumn("_context", P.context_failures(F.col("feature"), F.col("alias"), F.col("quote")))
    c = c.withColumn("failures", F.array_sort(F.array_distinct(F.concat("_context", "_structural")))).withColumn("accepted", F.size("failures") == 0)
    first = F.min(F.when(F.col("accepted"), F.col("ord"))).over(Window.partitionBy(key, "feature"))
    audit = c.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("ord") <= F.col("_first"))).select(key, "feature", "ord", "alias", "start", "quote", "failures", "accepted")
    return audit.where("accepted"), audit


def guarded_proposal(label: Column, proposed: Column, grounded: Column, semantic: Column, rescued: Column) -> Column:
    """V4, V6: what becomes of a refiner's proposal: an ungrounded or semantically failing "Yes" turns to "No" unless a
    rescue, itself grounded and without failures, stands for it; an unknown label keeps the old one."""
    sound = F.coalesce(grounded, F.lit(False)) & (F.size(semantic) == 0)
    return F.when(~F.coalesce(proposed.isin("Yes", "No"), F.lit(False)), label).when((proposed == "Yes") & ~sound, F.when(F.coalesce(rescued, F.lit(False)), "Yes").otherwise("No")).otherwise(proposed)


def checked_negative(label: Column, recovered: Column, backend_quote: Column, grounded: Column, failures: Column) -> Column:
    """V2: where missed evidence of a "No" comes from: the deterministic scan, else the backend's quotation if it is
    grounded and has no failures; null for none."""
    ok = backend_quote.isNotNull() & F.coalesce(grounded, F.lit(False)) & (F.size(failures) == 0)
    return F.when(label == "No", F.when(F.coalesce(recovered, F.lit(False)), "deterministic").when(ok, "backend"))


# Judgments of a domain of certainty and what each takes off.
DOWNGRADES = {"not serious": 0, "serious": 1, "very serious": 2}
DOMAINS = ("risk_of_bias", "inconsistency", "indirectness", "imprecision", "publication_bias")
NAMES = {"VERY_LOW": 1, "LOW": 2, "MODERATE": 3, "HIGH": 4}


def profile_violations(profiles: DataFrame, findings: tuple[str, ...]) -> DataFrame:
    """Profiles with what is wrong in each: unknown judgments, unknown finding, blank rationales, repeated ids,
    a stated certainty that the arithmetic does not give."""
    points = F.lit(0)
    codes = []
    for d in DOMAINS:
        j = F.lower(F.trim(F.col(d)))
        points = points + F.coalesce(F.when(j == "serious", 1).when(j == "very serious", 2), F.lit(0))
        codes += [F.when(j.isNull() | ~j.isin(*DOWNGRADES), f"{d.upper()}_UNKNOWN"), F.when((j != "not serious") & (F.trim(F.coalesce(F.col(f"{d}_rationale"), F.lit(""))) == ""), f"{d.upper()}_WITHOUT_RATIONALE")]
    due = F.greatest(F.lit(1), F.least(F.lit(4), F.col("start").try_cast("int") - points + F.coalesce(F.col("upgrade").try_cast("int"), F.lit(0))))
    stated = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))[F.upper("final")]
    codes += [
        F.when(~F.coalesce(F.col("finding").isin(*findings), F.lit(False)), "FINDING_UNKNOWN"), F.when(stated.isNull() | (stated != due), "CERTAINTY_DOES_NOT_FOLLOW"),
        F.when(F.count("*").over(Window.partitionBy("body_id")) > 1, "ID_REPEATED"),
    ]
    return profiles.withColumn("violations", F.array_compact(F.array(*codes)))


def profile_counts(profiles: DataFrame) -> DataFrame:
    """E5: how many profiles of each protocol and origin."""
    return profiles.groupBy("protocol", "origin").agg(F.count("*").alias("n"))


def query_variants(finding: Column, terms: Column, broader: Column, concepts: Column) -> Column:
    """Base, note_anchored (at most two terms of the note) and ontology_expanded (at most three broader terms and
    three concepts); parts once, in order, and a variant only if it says something new."""
    words = lambda *parts: F.array_join(F.array_distinct(F.transform(F.concat(*parts), lambda x: F.lower(F.trim(x)))), " ")
    base = F.array(finding)
    all_ = F.array(
        F.struct(F.lit("base").alias("name"), words(base).alias("query")), F.struct(F.lit("note_anchored").alias("name"), words(base, F.slice(terms, 1, 2)).alias("query")),
        F.struct(F.lit("ontology_expanded").alias("name"), words(base, F.slice(broader, 1, 3), F.slice(concepts, 1, 3)).alias("query")),
    )
    return F.filter(all_, lambda x, i: (i == 0) | ~F.exists(F.slice(all_, 1, i), lambda y: y["query"] == x["query"]))


def refined_query(base: Column, critique: Column, round_no: Column, extra: Column, most: int = 15) -> Column:
    """The query of a later round: the same after a correct answer, else with more terms each round."""
    more = F.slice(extra, 1, F.least(F.lit(most), round_no * 5))
    return F.when(critique == "Correct", base).otherwise(F.concat_ws(" ", base, F.array_join(more, " ")))


def rendered(passages: DataFrame, query: str, order: str, text: str, tier: str) -> DataFrame:
    """The kept passages of a query as one numbered text; a query keeps a few passages only."""
    one = F.struct(F.col(order).alias("o"), F.concat(F.lit("["), F.col(order), F.lit("] ("), F.coalesce(tier, F.lit("UNMAPPED")), F.lit(") "), F.col(text)).alias("t"))
    return passages.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n").alias("evidence"))


def alias_section(lexicon: DataFrame, most: int = 12) -> DataFrame:
    """The first aliases of each finding as one line; the lexicon is small and fixed."""
    kept = lexicon.where(F.col("ord") < most)
    return kept.groupBy("feature").agg(F.concat(F.first("feature"), F.lit(": "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"]), ", ")).alias("line"))


def confidence_of(df: DataFrame, key: str, features: tuple[str, ...], long_column: str | None = None) -> DataFrame:
    """H6: (key, feature, confidence) from a long column, or from the first of the wide names that a frame has."""
    if long_column and long_column in df.columns:
        return df.groupBy(key, "feature").agg(F.min(F.col(long_column).try_cast("double")).alias("confidence"))
    parts = []
    for f in features:
        names = (f"{f} confidence", f"{f}_confidence", f"{f} conf", f"confidence {f}")
        have = next((n for n in names if n in df.columns), None)
        parts.append(F.struct(F.lit(f).alias("feature"), (F.col(f"`{have}`").try_cast("double") if have else F.lit(None).cast("double")).alias("confidence")))
    return df.select(key, F.explode(F.array(*parts)).alias("c")).select(key, "c.*")


def prompt(template: str, **columns: Column) -> Column:
    """H9: a template with {names} filled by columns; the wording is the caller's resource."""
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)))
