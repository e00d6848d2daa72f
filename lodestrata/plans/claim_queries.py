"""Queries of claims, refinements, ablations and evaluation designs (H15-H19, V, X, Q, J4, J5, N12), with their DuckDB forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..operators import claims as C
from ..operators import loop, stats
from ..sources.tables import table
from .core_queries import _GOLD, _NID, CLAIMS, GOLD, NOTES, PAIRS, scored_pairs
from .rule_queries import _FAM, _SEMANTIC, _contains_any, _fold, _label, _strip, _texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(x: str) -> str:
    return _strip(f"coalesce(CAST({x} AS VARCHAR), '')")


_KEYS = ["_run_row_index", "feature"]
_PAIR = ("final_loop_prediction", "final_loop_evidence", "final_loop_section", "final_loop_experiencer", "final_loop_assertion", "initial_agent3_verdict", "final_grounding_level", "reached_max_refinement_bound")
_FIRST_PAIR = f"fp AS (SELECT _run_row_index, feature, {', '.join(_PAIR)} FROM verge_final_pair_level QUALIFY row_number() OVER (PARTITION BY _run_row_index, feature ORDER BY pair_id) = 1)"


def first_pairs(spark, sf_dir) -> DataFrame:
    """The first pair of each note and finding."""
    g = table(spark, sf_dir, PAIRS).groupBy(*_KEYS).agg(F.min_by(F.struct(*_PAIR), "pair_id").alias("p"))
    return g.select(*_KEYS, "p.*")


def claims_with_pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, CLAIMS).join(first_pairs(spark, sf_dir), _KEYS, "left")


# --- claims (H15, X7, H19) ----------------------------------------------------------------------------------------


def _prefer(a: str, b: str, default: str) -> str:
    return f"lower(CASE WHEN {_text(a)} <> '' THEN {_text(a)} WHEN {_text(b)} <> '' THEN {_text(b)} ELSE '{default}' END)"


@query(f"""
WITH {_FIRST_PAIR} SELECT claim_id, {_label('prediction')} AS prediction, {_text('evidence_quote')} AS evidence_quote, {_prefer('note_section', 'final_loop_section', 'unknown')} AS note_section,
  {_prefer('experiencer', 'final_loop_experiencer', 'unknown')} AS experiencer, {_prefer('assertion_status', 'final_loop_assertion', 'unknown')} AS assertion_status, length({_text('evidence_quote')}) > 5 AS has_evidence,
  {_FAM} AS is_family_history, {_text('structurer_operational_error')} AS structurer_operational_error FROM agent2_claims_pair_level LEFT JOIN fp USING (_run_row_index, feature)""")
def built_claims(spark, sf_dir):
    """Claims with their own fields first, the backend's where one is blank, else a default."""
    d = claims_with_pairs(spark, sf_dir)
    pick = lambda a, b: C.prefer(F.col(a), F.col(b), "unknown")
    fields = {"note_section": pick("note_section", "final_loop_section"), "experiencer": pick("experiencer", "final_loop_experiencer"), "assertion_status": pick("assertion_status", "final_loop_assertion")}
    made = C.build_claim(F.col("feature"), N.label(F.col("prediction")), F.col("confidence"), F.col("original_inference"), F.col("evidence_quote"), fields, F.col("structurer_source"), F.col("structurer_operational_error"))
    out = d.select("claim_id", *made)
    return out.select("claim_id", "prediction", "evidence_quote", *fields, "has_evidence", "is_family_history", "structurer_operational_error")


@query(f"""
SELECT pair_id, coalesce(operational_failure, false) OR upper({_text('final_grounding_level')}) = 'ERROR' OR starts_with(upper({_text('exit_reason')} || ':'), 'VERIFICATION_ERROR:') OR starts_with(upper({_text('final_bound_verification_verdict')} || ':'), 'VERIFICATION_OPERATIONAL_ERROR:') AS error
FROM verge_final_pair_level""")
def verification_errors(spark, sf_dir):
    """H19."""
    found = F.array(*(F.concat(C.text(F.col(x)), F.lit(":")) for x in ("exit_reason", "final_bound_verification_verdict")))
    return table(spark, sf_dir, PAIRS).select("pair_id", C.verification_error(F.col("operational_failure"), F.col("final_grounding_level"), found).alias("error"))


# --- verdicts and refinement (V1-V6, H17, H18) --------------------------------------------------------------------


def _g(x: str, note: str = "note") -> str:
    return f"(length(regexp_replace({_text(x)}, '\\s+', '', 'g')) > 5 AND coalesce(contains({note}, {_text(x)}) OR ({_fold(_text(x))} <> '' AND contains({_fold(note)}, {_fold(_text(x))})), false))"


_VERDICT = f"""{_FIRST_PAIR}, c AS (SELECT claim_id, feature, {_label('prediction')} AS l, coalesce(final_grounding_level, 'NOT_APPLICABLE') AS lev, coalesce(has_evidence, false) AS sf, lower({_text('assertion_status')}) IN ('affirmed', 'historical') AS cv,
  {_g('evidence_quote', 'n.Clean_note_text')} AS ds, {_contains_any('relation_found', V.RELATION_TERMS)} AS rs, {_contains_any('cancer_type_found', V.CRC_TERMS)} AS cs, {_g('final_loop_evidence', 'n.Clean_note_text')} AND final_loop_prediction = 'Yes' AS rec
  FROM agent2_claims_pair_level LEFT JOIN fp USING (_run_row_index, feature) LEFT JOIN rebuilt_notes_by_noteid n USING (_run_row_index)),
i AS (SELECT claim_id, array_to_string(list_filter([{', '.join(f"CASE WHEN l = 'Yes' AND lev = '{k}' THEN '{C.ISSUES[k]}' END" for k in ('NOT_APPLICABLE', 'NONE', 'WEAK'))},
  {', '.join(f"CASE WHEN l = 'Yes' AND NOT {c} THEN '{C.ISSUES[k]}' END" for k, c in (('source_faithfulness', 'sf'), ('contextual_validity', 'cv'), ('direct_support', 'ds')))},
  {', '.join(f"CASE WHEN l = 'Yes' AND {_FAM} AND NOT {c} THEN '{C.ISSUES[k]}' END" for k, c in (('relation_specificity', 'rs'), ('cancer_specificity', 'cs')))},
  CASE WHEN l = 'No' AND coalesce(rec, false) THEN '{C.ISSUES['recovered']}' END, CASE WHEN l IS NULL THEN '{C.ISSUES['label']}' END], lambda x: x IS NOT NULL), ';') AS issues FROM c)"""


@query(f"WITH {_VERDICT} SELECT claim_id, issues, CASE WHEN issues = '' THEN 'VERIFIED' ELSE 'REFINE' END AS verdict FROM i")
def verdicts(spark, sf_dir):
    """V1-V3: issues and verdict; the level is the stored grounding's, a "No" has recovered evidence where the loop's own
    positive evidence is in the note."""
    from ..functions import policy as P

    note = table(spark, sf_dir, NOTES).select("_run_row_index", F.col("Clean_note_text").alias("note"))
    d = claims_with_pairs(spark, sf_dir).join(note, "_run_row_index", "left")
    dims = {
        "source_faithfulness": F.col("has_evidence"), "contextual_validity": F.lower(C.text(F.col("assertion_status"))).isin("affirmed", "historical"), "direct_support": C.grounded_in(F.col("evidence_quote"), F.col("note")),
        "relation_specificity": P.has_any(F.col("relation_found"), V.RELATION_TERMS), "cancer_specificity": P.has_any(F.col("cancer_type_found"), V.CRC_TERMS),
    }
    recovered = C.grounded_in(F.col("final_loop_evidence"), F.col("note")) & (F.col("final_loop_prediction") == "Yes")
    found = C.issues(N.label(F.col("prediction")), F.col("final_grounding_level"), dims, recovered, F.col("feature") == V.FAMILY)
    return d.select("claim_id", F.array_join(found, ";").alias("issues"), loop.verdict(found).alias("verdict"))


def _sem(prefix: dict[str, str]) -> str:
    """Whether P14 has a failure, for columns of other names."""
    out = []
    for _, cond in _SEMANTIC:
        for a, b in prefix.items():
            cond = cond.replace(a, b)
        out.append(f"({cond})")
    return "(" + " OR ".join(out) + ")"


_NEW = {"assertion_status": "asr", "experiencer": "exp", "relation_found": "rel", "cancer_type_found": "can", "evidence_quote": "e"}
_REFINE = f"""{_FIRST_PAIR}, d0 AS (SELECT claim_id, feature, {_label('prediction')} AS p, evidence_quote, note_section, experiencer, assertion_status, relation_found, cancer_type_found, initial_agent3_verdict AS v, final_loop_prediction AS np, n.Clean_note_text AS note,
  coalesce(reached_max_refinement_bound, false) AS used, {_text('final_loop_evidence')} AS e, lower({_text('final_loop_section')}) AS sec, CASE WHEN lower({_text('final_loop_experiencer')}) IN ({_texts(V.EXPERIENCERS)}) THEN lower({_text('final_loop_experiencer')}) ELSE '' END AS exp,
  CASE WHEN lower({_text('final_loop_assertion')}) IN ({_texts(V.ASSERTIONS)}) THEN lower({_text('final_loop_assertion')}) ELSE 'unknown' END AS asr, lower({_text('relation_found')}) AS rel, lower({_text('cancer_type_found')}) AS can
  FROM agent2_claims_pair_level LEFT JOIN fp USING (_run_row_index, feature) LEFT JOIN rebuilt_notes_by_noteid n USING (_run_row_index)),
d1 AS (SELECT *, {_g('e')} AS g, {_g('evidence_quote')} AND NOT {_sem({})} AS safe,
  CASE WHEN v = 'VERIFIED' THEN NULL WHEN v IS DISTINCT FROM 'REFINE' THEN 'UNEXPECTED_VERDICT' WHEN p IS NULL THEN 'INVALID_CLAIM' WHEN {_text('note')} = '' THEN 'EMPTY_NOTE' WHEN np IS NULL OR np NOT IN ('Yes', 'No') THEN 'INVALID_PROPOSAL' END AS err FROM d0),
d2 AS (SELECT *, coalesce(v = 'REFINE', false) AND err IS NULL AS op, CASE WHEN np IS DISTINCT FROM 'Yes' THEN NULL WHEN NOT g THEN 'UNGROUNDED' WHEN {_FAM} AND NOT ({_contains_any('rel', V.RELATION_TERMS)} AND {_contains_any('can', V.CRC_TERMS)}) THEN 'FAMILY_INCOMPLETE'
  WHEN {_sem(_NEW)} THEN 'SEMANTIC' END AS lost FROM d1),
d3 AS (SELECT *, coalesce(np = 'No', false) OR lost IS NOT NULL AS no FROM d2), d4 AS (SELECT *, op AND coalesce(p = 'Yes', false) AND no AND NOT used AND safe AS rescued FROM d3),
r AS (SELECT claim_id, v, err, lost, op, rescued, p, {_text('evidence_quote')} AS oe, lower({_text('note_section')}) AS os, lower({_text('experiencer')}) AS ox, lower({_text('assertion_status')}) AS oa, lower({_text('relation_found')}) AS orl, lower({_text('cancer_type_found')}) AS oc,
  CASE WHEN NOT op THEN p WHEN rescued OR NOT no THEN 'Yes' ELSE 'No' END AS cp, CASE WHEN NOT op OR rescued THEN {_text('evidence_quote')} WHEN lost IS NOT NULL OR (no AND NOT g) THEN '' ELSE e END AS ce,
  CASE WHEN NOT op OR rescued THEN lower({_text('note_section')}) WHEN no AND sec = '' THEN 'none' ELSE sec END AS cs, CASE WHEN NOT op OR rescued THEN lower({_text('experiencer')}) WHEN coalesce(lost IN ('FAMILY_INCOMPLETE', 'SEMANTIC'), false) THEN '' ELSE exp END AS cx,
  CASE WHEN NOT op OR rescued THEN lower({_text('assertion_status')}) WHEN lost IS NOT NULL OR (no AND asr NOT IN ('negated', 'absent', 'historical', 'unknown')) THEN 'absent' ELSE asr END AS ca,
  CASE WHEN NOT op OR rescued THEN lower({_text('relation_found')}) WHEN lost IS NOT NULL THEN '' ELSE rel END AS crl, CASE WHEN NOT op OR rescued THEN lower({_text('cancer_type_found')}) WHEN lost IS NOT NULL THEN '' ELSE can END AS cc FROM d4)"""


def refined(spark, sf_dir) -> DataFrame:
    """Claims with the loop's result as the proposal and the claim's own evidence as the rescue."""
    note = table(spark, sf_dir, NOTES).select("_run_row_index", F.col("Clean_note_text").alias("note"))
    d = claims_with_pairs(spark, sf_dir).join(note, "_run_row_index", "left").withColumn("prediction", N.label(F.col("prediction")))
    d = d.withColumns(
        {
            "verdict": F.col("initial_agent3_verdict"), "new_prediction": F.col("final_loop_prediction"), "new_evidence": F.col("final_loop_evidence"), "new_note_section": F.col("final_loop_section"),
            "new_experiencer": F.col("final_loop_experiencer"), "new_assertion_status": F.col("final_loop_assertion"), "new_relation_found": F.col("relation_found"), "new_cancer_type_found": F.col("cancer_type_found"),
            "rescue_evidence": F.col("evidence_quote"), **{f"rescue_{k}": F.col(k) for k in C.FIELDS}, "rescue_used": F.coalesce("reached_max_refinement_bound", F.lit(False)),
        }
    )
    return C.refine(d)


@query(f"""
WITH {_REFINE} SELECT claim_id, cp AS corrected_prediction, md5(ce) AS corrected_evidence, cs AS corrected_note_section, cx AS corrected_experiencer, ca AS corrected_assertion_status, rescued, op AS refined, err IS NOT NULL AS operational_error, coalesce(err, CASE WHEN op THEN lost END) AS reason,
  CASE WHEN coalesce(v = 'VERIFIED', false) THEN 'UNCHANGED' WHEN err IS NOT NULL THEN 'REFINEMENT_ERROR' WHEN p = 'Yes' AND cp = 'No' THEN 'REJECTED' WHEN p = 'No' AND cp = 'Yes' THEN 'RECOVERED' WHEN p IS DISTINCT FROM cp THEN 'LABEL_CHANGED'
    WHEN ce <> oe THEN 'EVIDENCE_CORRECTED' WHEN cs <> os OR cx <> ox OR ca <> oa OR crl <> orl OR cc <> oc THEN 'METADATA_CORRECTED' ELSE 'CONFIRMED' END AS change_type FROM r""")
def refined_claims(spark, sf_dir):
    """The guards in order."""
    d = refined(spark, sf_dir)
    keep = ("corrected_note_section", "corrected_experiencer", "corrected_assertion_status", "rescued", "refined", "operational_error", "reason", "change_type")
    return d.select("claim_id", "corrected_prediction", F.md5("corrected_evidence").alias("corrected_evidence"), *keep)


@query(f"""
WITH {_REFINE}, q AS (SELECT r.*, a.evidence_quote AS q0 FROM r JOIN agent2_claims_pair_level a USING (claim_id))
SELECT claim_id, CASE WHEN op THEN cp ELSE p END AS prediction, md5(CASE WHEN op THEN ce ELSE q0 END) AS evidence_quote, CASE WHEN op THEN 'refiner' ELSE 'original' END AS claim_state_source FROM q""")
def promoted_claims(spark, sf_dir):
    """H18."""
    d = C.promote(refined(spark, sf_dir))
    return d.select("claim_id", "prediction", F.md5("evidence_quote").alias("evidence_quote"), "claim_state_source")


# --- pair rows and ablations (V7-V13, H21) ------------------------------------------------------------------------


@query("""
WITH c AS (SELECT * FROM agent2_claims_pair_level QUALIFY row_number() OVER (PARTITION BY _run_row_index, feature ORDER BY claim_id) = 1), p AS (SELECT * FROM verge_final_pair_level QUALIFY row_number() OVER (PARTITION BY _run_row_index, feature ORDER BY pair_id) = 1),
j AS (SELECT coalesce(c._run_row_index, p._run_row_index) AS r, coalesce(c.feature, p.feature) AS feature, c.claim_id, p.pair_id, c.prediction AS before, coalesce(p.final_loop_prediction, c.prediction) AS after, coalesce(p.total_refinement_rounds, 0) AS rounds FROM c FULL JOIN p ON c._run_row_index = p._run_row_index AND c.feature = p.feature)
SELECT r AS _run_row_index, feature, claim_id, pair_id, before, after, CAST(rounds AS INTEGER) AS rounds, count(*) OVER (PARTITION BY r) = 7 AS complete FROM j""")
def pair_rows(spark, sf_dir):
    """A row for each note and finding from the first claim and the first result, and whether its note has all seven."""
    c = table(spark, sf_dir, CLAIMS).groupBy(*_KEYS).agg(F.min_by(F.struct("claim_id", "prediction"), "claim_id").alias("c"))
    p = table(spark, sf_dir, PAIRS).groupBy(*_KEYS).agg(F.min_by(F.struct("pair_id", "final_loop_prediction", "total_refinement_rounds"), "pair_id").alias("p"))
    j = c.join(p, _KEYS, "full")
    out = j.select(
        *_KEYS, "c.claim_id", "p.pair_id", F.col("c.prediction").alias("before"), F.coalesce("p.final_loop_prediction", "c.prediction").alias("after"), F.coalesce("p.total_refinement_rounds", F.lit(0)).alias("rounds")
    )
    return out.withColumn("complete", F.count("*").over(Window.partitionBy("_run_row_index")) == 7)


_RUNS = f"(VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in C.SWITCHES)}) AS s(run)"


@query(f"""
WITH h AS (SELECT pair_id, initial_agent3_verdict AS v, final_agent3_verdict AS v1, final_grounding_level AS lev, operational_failure AS bad, agent5_final_label AS judge, from_json(label_history, '["VARCHAR"]') AS l FROM verge_final_pair_level WHERE label_history IS NOT NULL),
g AS (SELECT run, h.*, CASE WHEN run = 'no_clinical_validation' AND l[1] = 'Yes' THEN CASE WHEN lev IN ('NONE', 'WEAK') THEN 'REFINE' ELSE 'VERIFIED' END WHEN run IN ('no_negative_recovery', 'developmental') AND l[1] = 'No' THEN 'VERIFIED' ELSE v END AS v0 FROM h, {_RUNS}),
x AS (SELECT *, len(l) - 1 AS n, coalesce(list_first(list_filter(range(1, len(l)), lambda i: l[i + 1] = l[i])), 99) AS same FROM g),
e AS (SELECT run, l, judge, CASE WHEN v0 = 'VERIFIED' THEN 'VERIFIED' WHEN v0 IS NULL OR v0 <> 'REFINE' THEN 'INVALID_INITIAL_VERIFIER_STATE' WHEN run = 'no_refiner' THEN 'REFINER_ABLATED' WHEN n = 0 THEN NULL
    WHEN run = 'no_reverification' THEN CASE WHEN n = 1 AND bad THEN 'REFINEMENT_ERROR' WHEN same = 1 THEN 'LABEL_STABLE' ELSE 'NO_REVERIFICATION' END
    WHEN same < n THEN 'LABEL_STABLE' WHEN bad THEN 'REFINEMENT_ERROR' WHEN same = n THEN 'LABEL_STABLE'
    WHEN v1 = 'VERIFIED' AND n >= 5 THEN 'MAX_ROUNDS_FINAL_VERIFIED' WHEN v1 = 'VERIFIED' THEN 'VERIFIED' WHEN n >= 5 THEN 'MAX_ROUNDS_LABEL_OSCILLATION' END AS exit_reason,
  CASE WHEN v0 IS DISTINCT FROM 'REFINE' OR run = 'no_refiner' THEN 0 WHEN run = 'no_reverification' THEN least(n, 1) ELSE least(n, same) END AS rounds, bad, n FROM x),
f AS (SELECT run, exit_reason, rounds, CASE WHEN run = 'no_final_judge' OR judge IS NULL OR judge NOT IN ('Yes', 'No') THEN CASE WHEN exit_reason = 'REFINEMENT_ERROR' THEN l[rounds] ELSE l[rounds + 1] END ELSE judge END AS label FROM e)
SELECT run, exit_reason, CAST(rounds AS INTEGER) AS rounds, label, count(*) AS pairs FROM f GROUP BY ALL""")
def loop_ablations(spark, sf_dir):
    """All runs in one pass over the pairs. Without the judge the loop's label stays; without the refiner or
    the second look the loop ends early; without clinical validation a "Yes" is only held against its grounding; without
    negative recovery, and in the developmental loop, which lacks the recovery scan, a "No" is never reopened."""
    p = table(spark, sf_dir, PAIRS).where("label_history is not null")
    labels = F.from_json("label_history", "array<string>")
    p = p.select("pair_id", F.col("initial_agent3_verdict").alias("v"), F.col("final_agent3_verdict").alias("v1"), F.col("final_grounding_level").alias("lev"), F.col("operational_failure").alias("bad"), F.col("agent5_final_label").alias("judge"), labels.alias("l"))
    n = F.size("l") - 1
    rounds = F.when(n > 0, F.transform(F.slice("l", 2, F.greatest(F.lit(1), n)), lambda x, i: F.struct(x.alias("label"), F.when(i == n - 1, F.col("v1")).otherwise("REFINE").alias("verdict"), (F.col("bad") & (i == n - 1)).alias("error"))))
    grounded = F.when(F.col("lev").isin("NONE", "WEAK"), "REFINE").otherwise("VERIFIED")
    first = {
        "no_clinical_validation": F.when(F.col("l")[0] == "Yes", grounded).otherwise(F.col("v")),
        **{k: F.when(F.col("l")[0] == "No", "VERIFIED").otherwise(F.col("v")) for k in ("no_negative_recovery", "developmental")},
    }
    runs = []
    for k in C.SWITCHES:
        s = loop.fold_rounds(first.get(k, F.col("v")), F.col("l")[0], rounds, reverify=k != "no_reverification", refine=k != "no_refiner")
        runs.append(F.struct(F.lit(k).alias("run"), s["exit_reason"].alias("exit_reason"), s["rounds"].alias("rounds"), s["label"].alias("looped")))
    d = p.select("judge", F.explode(F.array(*runs)).alias("r")).select("judge", "r.*")
    judged = F.when((F.col("run") == "no_final_judge") | ~F.coalesce(F.col("judge").isin("Yes", "No"), F.lit(False)), F.col("looped")).otherwise(F.col("judge"))
    return d.groupBy("run", "exit_reason", "rounds", judged.alias("label")).agg(F.count("*").alias("pairs"))


@query("""
WITH o AS (SELECT pair_id, from_json(label_history, '["VARCHAR"]') AS l, agent4_generated_prediction AS a, agent5_final_label AS b, final_agent3_verdict AS v FROM verge_final_pair_level WHERE exit_reason = 'MAX_ROUNDS_LABEL_OSCILLATION' AND label_history IS NOT NULL)
SELECT pair_id, CASE WHEN a = l[-1] THEN 'LABEL_STABLE' WHEN b = a THEN 'LABEL_STABLE' WHEN v = 'VERIFIED' THEN 'MAX_ROUNDS_FINAL_VERIFIED' WHEN v = 'REFINE' THEN 'MAX_ROUNDS_LABEL_OSCILLATION' ELSE 'MAX_ROUNDS_FINAL_VERIFICATION_ERROR' END AS exit_reason,
  CAST(CASE WHEN a = l[-1] THEN 6 ELSE 7 END AS INTEGER) AS rounds FROM o WHERE a IN ('Yes', 'No') AND b IN ('Yes', 'No')""")
def bound_extension(spark, sf_dir):
    """V8: pairs that still oscillated after five rounds, carried on to the seventh from their stored state; the refiner's
    and the judge's labels stand for the two rounds."""
    p = table(spark, sf_dir, PAIRS).where("exit_reason = 'MAX_ROUNDS_LABEL_OSCILLATION' and label_history is not null and agent4_generated_prediction in ('Yes', 'No') and agent5_final_label in ('Yes', 'No')")
    labels = F.from_json("label_history", "array<string>")
    more = F.array(
        F.struct(F.col("agent4_generated_prediction").alias("label"), F.lit("REFINE").alias("verdict"), F.lit(False).alias("error")),
        F.struct(F.col("agent5_final_label").alias("label"), F.col("final_agent3_verdict").alias("verdict"), F.lit(False).alias("error")),
    )
    s = loop.fold_rounds(F.lit("REFINE"), F.element_at(labels, -1), more, bound=7, made=5)
    return p.select("pair_id", s.alias("s")).select("pair_id", "s.exit_reason", "s.rounds")


# --- evaluation (Q3, Q6-Q9, Q12, Q17, Q18, Q20, Q21, J4, J5, N12) ---------------------------------------------------

_C4 = "count(*) FILTER (gold='Yes' AND {0}='Yes') AS tp, count(*) FILTER (gold='No' AND {0}='Yes') AS fp, count(*) FILTER (gold='Yes' AND {0}='No') AS fn, count(*) FILTER (gold='No' AND {0}='No') AS tn"


@query(f"""
WITH {_GOLD}, f AS (SELECT feature, {_C4.format('after')}, count(*) AS pairs, count(after) AS n FROM scored GROUP BY feature),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp + fn AS support FROM f)
SELECT CAST(sum(pairs) AS BIGINT) AS pairs, round(sum(n) / sum(pairs), 6) AS coverage, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / nullif(sum(support), 0), 6) AS weighted_f1,
  round(1 - sum(tp + tn) / nullif(sum(tp + fp + fn + tn), 0), 6) AS hamming_loss, round(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 6) AS micro_f1, round(sum(2 * p * r / nullif(p + r, 0)) / count(2 * p * r / nullif(p + r, 0)), 6) AS macro_f1_of_rates FROM m""")
def macro_scores(spark, sf_dir):
    """Micro, macro (nulls left out), support-weighted, Hamming loss and coverage."""
    return stats.run_scores(scored_pairs(spark, sf_dir), "feature", "gold", "after").select(
        "pairs", *(F.round(k, 6).alias(k) for k in ("coverage", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "hamming_loss", "micro_f1", "macro_f1_of_rates"))
    )


REPS = 1000
_WEIGHT = "CASE " + " ".join(f"WHEN u < {t} THEN {i}" for i, t in enumerate(stats.THRESHOLDS)) + f" ELSE {len(stats.THRESHOLDS)} END"


def _drawn(units: str) -> str:
    """Common tables d (rep, unit, w) of the units: eight replicates from each digest."""
    return f"""k AS (SELECT unit, b, md5(unit || '/' || b) AS h FROM ({units}), (SELECT unnest(range(0, {REPS // 8})) AS b)), z AS (SELECT unit, b * 8 + j AS rep, CAST('0x' || substr(h, CAST(1 + 4 * j AS INTEGER), 4) AS INTEGER) AS u FROM k, (SELECT unnest(range(0, 8)) AS j)),
d AS (SELECT unit, rep, {_WEIGHT} AS w FROM z)"""


_F1 = "CAST(2 * sum(w * tp) AS DOUBLE) / nullif(CAST(sum(w * (2 * tp + fp + fn)) AS DOUBLE), 0)"


@query(f"""
WITH {_GOLD}, u AS (SELECT nid AS unit, feature, {_C4.format('after')} FROM scored GROUP BY 1, 2), {_drawn('SELECT DISTINCT unit FROM u')},
f AS (SELECT rep, feature, {_F1} AS f1 FROM u JOIN d USING (unit) GROUP BY rep, feature) SELECT feature, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high, count(f1) AS reps FROM f GROUP BY feature""")
def bootstrap_ci(spark, sf_dir):
    """Q6, Q8: 1,000 replicates over all notes, whatever their ids; drawn by a digest of the note, so any engine draws alike."""
    u = scored_pairs(spark, sf_dir).groupBy(F.col("nid").alias("unit"), "feature").agg(*stats.confusion(F.col("gold"), F.col("after")))
    b = stats.bootstrap_digest(u, "unit", "feature", ["tp", "fp", "fn", "tn"], REPS)
    f1 = b.select("feature", stats.metrics(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))["f1"].alias("f1"))
    ci = stats.percentile_ci(F.col("f1"))
    return f1.groupBy("feature").agg(ci.alias("ci"), F.count("f1").alias("reps")).select("feature", F.round(F.col("ci")[0], 6).alias("low"), F.round(F.col("ci")[1], 6).alias("high"), "reps")


_PAT = f"""pat AS (SELECT {_NID.format('NOTE_ID')} AS nid, min({_NID.format('PAT_ID')}) AS pat FROM gold_pairs WHERE PAT_ID IS NOT NULL GROUP BY 1)"""


@query(f"""
WITH {_GOLD}, {_PAT}, u AS (SELECT pat AS unit, {_C4.format('before')}, {', '.join(x.strip().replace(' AS tp', ' AS tp2').replace(' AS fp', ' AS fp2').replace(' AS fn', ' AS fn2').replace(' AS tn', ' AS tn2') for x in _C4.format('after').split(', '))} FROM scored JOIN pat USING (nid) WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY 1), {_drawn('SELECT unit FROM u')},
f AS (SELECT rep, {_F1} AS f1, CAST(2 * sum(w * tp2) AS DOUBLE) / nullif(CAST(sum(w * (2 * tp2 + fp2 + fn2)) AS DOUBLE), 0) AS f2 FROM u JOIN d USING (unit) GROUP BY rep)
SELECT round(quantile_cont(f2 - f1, 0.025), 6) AS low, round(quantile_cont(f2 - f1, 0.975), 6) AS high, round(least(1.0::DOUBLE, 2 * least((count(*) FILTER (f2 - f1 <= 0) + 1) / (count(f2 - f1) + 1), (count(*) FILTER (f2 - f1 >= 0) + 1) / (count(f2 - f1) + 1))), 6) AS p FROM f""")
def bootstrap_patients(spark, sf_dir):
    """Q7-Q9, Q12: the difference in F1 between the loop and the extractor, patients drawn whole, with its p value."""
    g = table(spark, sf_dir, GOLD).where("PAT_ID is not null").groupBy(N.normalize_id(F.col("NOTE_ID")).alias("nid")).agg(F.min(N.normalize_id(F.col("PAT_ID"))).alias("pat"))
    s = scored_pairs(spark, sf_dir).where("before is not null and after is not null").join(g, "nid")
    names = ["tp", "fp", "fn", "tn"]
    second = [c.alias(f"{n}2") for c, n in zip(stats.confusion(F.col("gold"), F.col("after")), names)]
    u = s.groupBy(F.col("pat").alias("unit")).agg(*stats.confusion(F.col("gold"), F.col("before")), *second).withColumn("part", F.lit("ALL"))
    b = stats.bootstrap_digest(u, "unit", "part", [*names, *(f"{n}2" for n in names)], REPS)
    f1 = lambda x: stats.metrics(*(F.col(n + x) for n in names))["f1"]
    d = b.select((f1("2") - f1("")).alias("d"))
    return d.agg(stats.percentile_ci(F.col("d")).alias("ci"), F.round(stats.bootstrap_p(F.col("d")), 6).alias("p")).select(F.round(F.col("ci")[0], 6).alias("low"), F.round(F.col("ci")[1], 6).alias("high"), "p")


_SYSTEMS = ("extractor", "judge", "loop")
_JUDGED = f"jd AS (SELECT {_NID.format('NOTE_ID')} AS nid, lower(feature) AS feature, arg_min_null(agent5_final_label, pair_id) AS judge FROM verge_final_pair_level WHERE NOTE_ID IS NOT NULL GROUP BY 1, 2)"


def systems(spark, sf_dir) -> DataFrame:
    """Scored pairs with the labels of three systems."""
    j = table(spark, sf_dir, PAIRS).where("NOTE_ID is not null").groupBy(N.normalize_id(F.col("NOTE_ID")).alias("nid"), F.lower("feature").alias("feature")).agg(F.min_by("agent5_final_label", "pair_id").alias("judge"))
    return scored_pairs(spark, sf_dir).join(j, ["nid", "feature"], "left").withColumnRenamed("before", "extractor").withColumnRenamed("after", "loop")


@query(
    f"WITH {_GOLD}, {_JUDGED}, t AS (SELECT s.gold, s.before AS extractor, s.after AS loop, judge FROM scored s LEFT JOIN jd USING (nid, feature)) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(avg(CAST({b} = gold AS INTEGER)) - avg(CAST({a} = gold AS INTEGER)), 6) AS accuracy, "
        + f"round(2 * count(*) FILTER (gold = 'Yes' AND {b} = 'Yes') / nullif(count(*) FILTER (gold = 'Yes') + count(*) FILTER ({b} = 'Yes'), 0) - 2 * count(*) FILTER (gold = 'Yes' AND {a} = 'Yes') / nullif(count(*) FILTER (gold = 'Yes') + count(*) FILTER ({a} = 'Yes'), 0), 6) AS f1 FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(_SYSTEMS) for b in _SYSTEMS[i + 1 :]
    )
)
def paired_deltas(spark, sf_dir):
    """Q12: b less a over the rows both have, for every pair of systems."""
    s = systems(spark, sf_dir)
    return stats.all_deltas(s, "gold", _SYSTEMS).select("a", "b", "n", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


_LEVELS = "CASE lower(agent5_confidence) WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 5 END"


@query(f"""
WITH {_GOLD}, j AS (SELECT lower(p.feature) AS feature, agent5_final_label AS label, CASE WHEN final_grounding_level IN ('STRONG', 'MODERATE') THEN 1 ELSE 0 END AS in_note, {_LEVELS} AS faith, CASE WHEN agent5_final_label = final_loop_prediction THEN 5 ELSE 1 END AS support, g.gold
  FROM verge_final_pair_level p LEFT JOIN gold g ON {_NID.format('p.NOTE_ID')} = g.nid AND lower(p.feature) = g.feature WHERE agent5_final_label = 'Yes'),
x AS (SELECT *, CASE WHEN gold = 'Yes' THEN 'TP' ELSE 'FP' END AS kind FROM j), y AS (SELECT *, unnest(['ALL', kind]) AS scope2 FROM x)
SELECT CASE WHEN GROUPING(feature) = 1 THEN 'ALL' ELSE feature END AS scope, scope2 AS correctness, count(*) AS n, round(avg(in_note), 6) AS evidence_in_note, round(avg(faith), 6) AS faithfulness, round(avg(CASE WHEN faith >= 4 THEN 1 ELSE 0 END), 6) AS faithfulness_4_5,
  round(avg(support), 6) AS support, round(avg(CASE WHEN support >= 4 THEN 1 ELSE 0 END), 6) AS support_4_5, round(avg(CASE WHEN support <= 2 THEN 1 ELSE 0 END), 6) AS support_1_2 FROM y GROUP BY GROUPING SETS ((feature, scope2), (scope2))""")
def judge_summary(spark, sf_dir):
    """The judge's positives by finding and all, and by whether gold agrees. The tables have no scores of the judge,
    so its confidence and its agreement with the loop stand for them."""
    p = table(spark, sf_dir, PAIRS).where("agent5_final_label = 'Yes'")
    faith = reduce(lambda c, kv: c.when(F.lower("agent5_confidence") == kv[0], kv[1]), (("medium", 3), ("high", 5)), F.when(F.lower("agent5_confidence") == "low", 2))
    j = p.select(
        N.normalize_id(F.col("NOTE_ID")).alias("nid"), F.lower("feature").alias("feature"), F.col("agent5_final_label").alias("label"), F.col("final_grounding_level").isin("STRONG", "MODERATE").alias("in_note"),
        faith.alias("faith"), F.when(F.col("agent5_final_label") == F.col("final_loop_prediction"), 5).otherwise(1).alias("support"),
    )
    gold = scored_pairs(spark, sf_dir).select("nid", "feature", "gold")
    return stats.judge_summary(j.join(gold, ["nid", "feature"], "left"), "feature", "gold", "label", "in_note", "faith", "support")


@query(f"""
WITH {_GOLD}, o AS (SELECT *, CASE WHEN before = 'No' AND after = 'Yes' THEN 'Yes' ELSE before END AS overlay FROM scored WHERE before IS NOT NULL AND after IS NOT NULL),
a AS (SELECT {_C4.format('before')} FROM o), b AS (SELECT {_C4.format('overlay')} FROM o),
m AS (SELECT 'a' AS k, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f, (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc FROM a
  UNION ALL SELECT 'b', tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), 2 * tp / nullif(2 * tp + fp + fn, 0), (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0) FROM b)
SELECT count(*) FILTER (before = 'No' AND overlay = 'Yes') AS accepted, count(*) FILTER (before = 'No' AND overlay = 'Yes' AND gold = 'Yes') AS tp_recovered, count(*) FILTER (before = 'No' AND overlay = 'Yes' AND gold = 'No') AS fp_added,
  (SELECT r >= 0.73 FROM m WHERE k = 'b') AS recall_ge_073, (SELECT p >= 0.84 FROM m WHERE k = 'b') AS precision_ge_084, (SELECT f FROM m WHERE k = 'b') > (SELECT f FROM m WHERE k = 'a') AS f1_gt_current, (SELECT mcc FROM m WHERE k = 'b') > (SELECT mcc FROM m WHERE k = 'a') AS mcc_gt_current FROM o""")
def recovery_gates(spark, sf_dir):
    """Q20: recovered pairs laid over the extractor's labels, and the four gates."""
    s = scored_pairs(spark, sf_dir).where("before is not null and after is not null")
    rec = (F.col("before") == "No") & (F.col("after") == "Yes")
    return stats.recovery_gates(s.select("gold", "before", F.when(rec, "Yes").otherwise(F.col("before")).alias("overlay")), "gold", "before", "overlay")


_ORDER_BY = "md5(nid || '/' || feature)"
_DESIGN = f"""{_GOLD}, t AS (SELECT nid, feature, gold, before, after, before <> after AS changed, before <> gold AND after <> gold AS shared, {_ORDER_BY} AS o FROM scored WHERE before IS NOT NULL AND after IS NOT NULL),
w AS (SELECT *, round(50 * avg(CAST(gold = 'Yes' AS INTEGER)) OVER (PARTITION BY feature)) AS pos, row_number() OVER (PARTITION BY feature, gold ORDER BY o) AS rn, row_number() OVER (PARTITION BY shared ORDER BY o) AS rs FROM t),
ds AS (SELECT nid, feature, rn <= CASE WHEN gold = 'Yes' THEN pos ELSE 50 - pos END AS in_representative, changed AS in_changed, shared AND rs <= 100 AS in_shared FROM w)"""


def sample_design(spark, sf_dir) -> DataFrame:
    s = scored_pairs(spark, sf_dir).where("before is not null and after is not null")
    t = s.select("nid", "feature", "gold", (F.col("before") != F.col("after")).alias("changed"), ((F.col("before") != F.col("gold")) & (F.col("after") != F.col("gold"))).alias("shared"))
    return stats.design(t, "feature", "gold", "changed", "shared", [F.md5(F.concat("nid", F.lit("/"), "feature"))])


@query(f"WITH {_DESIGN} SELECT nid, feature, in_representative, in_changed, in_shared FROM ds WHERE in_representative OR in_changed OR in_shared")
def stratified_design(spark, sf_dir):
    """50 rows of each finding at its prevalence, all changed ones and 100 shared errors, with a flag for each set
    (the samples are the feature; they are drawn in the order of a digest)."""
    return sample_design(spark, sf_dir).where("in_representative or in_changed or in_shared").select("nid", "feature", "in_representative", "in_changed", "in_shared")


@query(f"WITH {_DESIGN} SELECT nid, feature FROM ds WHERE in_changed ORDER BY nid, feature LIMIT 20")
def mode_filtered(spark, sf_dir):
    """The changed ones, the first 20 in order (the limit is the feature)."""
    return sample_design(spark, sf_dir).where("in_changed").select("nid", "feature").orderBy("nid", "feature").limit(20)


@query(f"""
WITH {_GOLD}, k AS (SELECT {_NID.format('NOTE_ID')} AS nid, lower(feature) AS feature, arg_min_null(confidence, claim_id) AS confidence FROM agent2_claims_pair_level WHERE NOTE_ID IS NOT NULL GROUP BY 1, 2)
SELECT s.nid, s.feature, gold, after, CAST(confidence AS INTEGER) AS confidence FROM scored s LEFT JOIN k USING (nid, feature)""")
def gold_confidence(spark, sf_dir):
    """Gold pairs with the prediction, then with the first claim's confidence."""
    k = table(spark, sf_dir, CLAIMS).where("NOTE_ID is not null").groupBy(N.normalize_id(F.col("NOTE_ID")).alias("nid"), F.lower("feature").alias("feature")).agg(F.min_by("confidence", "claim_id").cast("int").alias("confidence"))
    return scored_pairs(spark, sf_dir).join(k, ["nid", "feature"], "left").select("nid", "feature", "gold", "after", "confidence")


@query(f"""
WITH {_GOLD}, q AS (SELECT feature, gold, before, after, CASE WHEN before = after THEN 'none' WHEN after = gold AND before <> gold THEN 'corrective' WHEN before = gold AND after <> gold THEN 'degrading' ELSE 'other' END AS k FROM scored WHERE before IS NOT NULL AND after IS NOT NULL)
SELECT CASE WHEN GROUPING(feature) = 1 THEN 'ALL' ELSE feature END AS scope, count(*) FILTER (k <> 'none') AS overrides, count(*) FILTER (k = 'corrective') AS corrective, count(*) FILTER (k = 'degrading') AS degrading,
  count(*) FILTER (k = 'corrective') - count(*) FILTER (k = 'degrading') AS net, count(*) FILTER (before = 'No' AND after = 'Yes') AS no_to_yes, count(*) FILTER (before = 'Yes' AND after = 'No') AS yes_to_no FROM q GROUP BY ROLLUP (feature)""")
def override_summary(spark, sf_dir):
    """Q18: what overriding a label brought, by finding and all, and in which direction."""
    s = scored_pairs(spark, sf_dir).where("before is not null and after is not null").withColumn("k", loop.change_quality(F.col("gold"), F.col("before"), F.col("after")))
    n = lambda c: F.count_if(c)
    aggs = [
        n(F.col("k") != "none").alias("overrides"), n(F.col("k") == "corrective").alias("corrective"), n(F.col("k") == "degrading").alias("degrading"), (n(F.col("k") == "corrective") - n(F.col("k") == "degrading")).alias("net"),
        n((F.col("before") == "No") & (F.col("after") == "Yes")).alias("no_to_yes"), n((F.col("before") == "Yes") & (F.col("after") == "No")).alias("yes_to_no"),
    ]
    return stats.by_scope(s, "feature", aggs).withColumnRenamed("feature", "scope")
