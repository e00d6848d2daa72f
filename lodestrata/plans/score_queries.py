"""Queries of grounding, retrieval, evidence, parsing, the loop and the statistics, with their DuckDB forms."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..operators import loop, parsing, retrieval, stats
from ..operators import text as T
from ..session import spread
from ..sources.tables import table
from .core_queries import _GOLD, _LABEL, CLAIMS, GOLD, NOTES, PAIRS, scored_pairs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- grounding (G1-G11) ------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+|[^\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\p{{L}}\\p{{N}}_]')"


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS kinds FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents WHERE text IS NOT NULL)")
def token_counts(spark, sf_dir):
    """G1."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", N.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("kinds"))


def quotes(spark, sf_dir) -> DataFrame:
    """Claims with a quotation and their note."""
    c = spread(table(spark, sf_dir, CLAIMS)).where(F.length(F.trim("evidence_quote")) > 5).select("claim_id", "_run_row_index", "feature", "prediction", "evidence_quote")
    return c.join(table(spark, sf_dir, NOTES).select("_run_row_index", "Clean_note_text"), "_run_row_index")


_QUOTED = "FROM agent2_claims_pair_level c JOIN rebuilt_notes_by_noteid n USING (_run_row_index) WHERE length(trim(evidence_quote, ' ')) > 5"


@query(f"""
SELECT claim_id, coalesce(length(regexp_replace(q, '\\s', '', 'g')) > 5 AND (contains(t, trim(q, ' ')) OR contains(f(t), f(q))), false) AS grounded
FROM (SELECT claim_id, evidence_quote AS q, Clean_note_text AS t {_QUOTED})""".replace("f(t)", "trim(regexp_replace(replace(replace(replace(replace(lower(t), '“', chr(34)), '”', chr(34)), '‘', chr(39)), '’', chr(39)), '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ')").replace("f(q)", "trim(regexp_replace(replace(replace(replace(replace(lower(q), '“', chr(34)), '”', chr(34)), '‘', chr(39)), '’', chr(39)), '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ')"))
def grounded_quotes(spark, sf_dir):
    """Exact or folded containment."""
    q = quotes(spark, sf_dir)
    return q.select("claim_id", T.contains_folded(F.col("Clean_note_text"), F.col("evidence_quote")).alias("grounded"))


@query(f"""
SELECT claim_id, coalesce(len(h) >= 4 AND contains(chr(1) || array_to_string(r, chr(1)) || chr(1), chr(1) || array_to_string(h, chr(1)) || chr(1)), false) AS run
FROM (SELECT claim_id, {_TOK.format('evidence_quote')} AS h, {_TOK.format('Clean_note_text')} AS r {_QUOTED})""")
def subsequence_match(spark, sf_dir):
    """G3."""
    q = quotes(spark, sf_dir)
    return q.select("claim_id", T.contains_tokens(F.col("Clean_note_text"), F.col("evidence_quote")).alias("run"))


@query(f"""
WITH q AS (SELECT claim_id, {_TOK.format('evidence_quote')} AS h, {_TOK.format('Clean_note_text')} AS r {_QUOTED}),
hc AS (SELECT claim_id, g, count(*) AS n FROM (SELECT claim_id, unnest(h) AS g FROM q) GROUP BY 1, 2), rc AS (SELECT claim_id, g, count(*) AS n FROM (SELECT claim_id, unnest(r) AS g FROM q) GROUP BY 1, 2)
SELECT claim_id, round(sum(least(hc.n, coalesce(rc.n, 0))) / sum(hc.n), 6) AS precision FROM hc LEFT JOIN rc USING (claim_id, g) GROUP BY claim_id""")
def unigram_precision(spark, sf_dir):
    """G5 as explode and join: a note's tokens are counted once, whatever the number of its quotations."""
    q = quotes(spark, sf_dir)
    h = q.select("claim_id", "_run_row_index", F.explode(N.tokens(F.col("evidence_quote"))).alias("g")).groupBy("claim_id", "_run_row_index", "g").agg(F.count("*").alias("n"))
    notes = table(spark, sf_dir, NOTES)
    r = notes.select("_run_row_index", F.explode(N.tokens(F.col("Clean_note_text"))).alias("g")).groupBy("_run_row_index", "g").agg(F.count("*").alias("m"))
    j = h.join(r, ["_run_row_index", "g"], "left")
    return j.groupBy("claim_id").agg(F.round(F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n"), 6).alias("precision"))


@query()
def grounding_levels(spark, sf_dir):
    """Every quotation graded."""
    g = T.grounding(quotes(spark, sf_dir), "claim_id", "Clean_note_text", "evidence_quote")
    return g.withColumn("critique", T.critique(F.col("bleu"))).groupBy("level", "critique").agg(F.count("*").alias("claims"), F.round(F.avg("rouge_l"), 4).alias("rouge_l"))


@query(f"""
SELECT CASE WHEN GROUPING(feature) = 1 THEN 'ALL' ELSE feature END AS feature, count(*) AS pairs, round(avg(bleu) FILTER (l = 'Yes'), 6) AS bleu_yes, round(avg(bleu) FILTER (l = 'No'), 6) AS bleu_no,
  round(count(*) FILTER (final_grounding_level = 'STRONG') / count(*), 6) AS strong
FROM (SELECT feature, final_grounding_level, CASE WHEN isnan(final_bleu) THEN NULL ELSE final_bleu END AS bleu, {_LABEL.format('final_loop_prediction')} AS l FROM verge_final_pair_level) GROUP BY ROLLUP (feature)""")
def grounding_by_scope(spark, sf_dir):
    """Rates and means for each finding and all."""
    p = table(spark, sf_dir, PAIRS).select("feature", "final_grounding_level", F.when(~F.isnan("final_bleu"), F.col("final_bleu")).alias("bleu"), N.label(F.col("final_loop_prediction")).alias("l"))
    of = lambda v: F.round(F.avg(F.when(F.col("l") == v, F.col("bleu"))), 6)
    aggs = [F.count("*").alias("pairs"), of("Yes").alias("bleu_yes"), of("No").alias("bleu_no"), F.round(F.count_if(F.col("final_grounding_level") == "STRONG") / F.count("*"), 6).alias("strong")]
    return stats.by_scope(p, "feature", aggs)


# --- retrieval and evidence (R2-R15, E1-E5, S2, J9) ------------------------------------------------------------------


def _label_queries(spark, sf_dir) -> tuple[np.ndarray, list]:
    """The first vector of each label: a bounded set of queries."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q")).orderBy("label").collect()
    return np.array([r.q for r in rows], np.float64), [int(r.label) for r in rows]


_SIM = """
q AS (SELECT label AS q, min_by(embedding, vec_id) AS qv FROM embeddings GROUP BY label),
s AS (SELECT CAST(q AS INTEGER) AS q, vec_id, list_sum(list_transform(list_zip(qv, embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS score FROM q, embeddings),
r AS (SELECT q, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""


@query(f"WITH {_SIM} SELECT q, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 32")
def dense_topk(spark, sf_dir):
    """R2, R3."""
    q, names = _label_queries(spark, sf_dir)
    d = retrieval.dense_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", q, names, 32)
    return d.select(F.col("q").cast("int").alias("q"), "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("""
WITH v AS (SELECT a.vec_id AS q, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT q, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM v) WHERE rank <= 32""")
def dense_search(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all."""
    d = retrieval.dense_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 32)
    return d.select("q", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"""
WITH {_SIM}, k AS (SELECT q // 3 AS g, q, vec_id, score, rank FROM r WHERE rank <= 32),
f AS (SELECT g, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(score) AS best FROM k GROUP BY g, vec_id),
o AS (SELECT g, vec_id, rrf, row_number() OVER (PARTITION BY g ORDER BY round(rrf, 12) DESC, round(best, 9) DESC, vec_id) AS rank FROM f)
SELECT CAST(g AS INTEGER) AS g, vec_id, round(rrf, 9) AS rrf, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 10""")
def rrf_fusion(spark, sf_dir):
    """Three query variants fused."""
    q, names = _label_queries(spark, sf_dir)
    d = retrieval.dense_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", q, names, 32).withColumn("g", F.floor(F.col("q") / 3).cast("int"))
    f = retrieval.rrf(d.withColumn("score", F.round("score", 9)), "g", "vec_id")
    return f.select("g", "vec_id", F.round("rrf", 9).alias("rrf"), F.col("rank").cast("int").alias("rank"))


_BM = """
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS t FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM d),
tf AS (SELECT doc_id, len(t) AS dl, u AS term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS u FROM d) GROUP BY doc_id, len(t), u), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i0 AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, st), i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
q AS (SELECT q, unnest(string_split(terms, ' ')) AS term FROM (VALUES ('pain', 'rectal pain worse after'), ('bleeding', 'rectal bleeding bright red blood'), ('loss', 'weight loss fell month')) v(q, terms)),
b AS (SELECT q, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))) AS score FROM q JOIN tf USING (term) JOIN i USING (term), st GROUP BY q, doc_id)"""


def _bm25_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("t"))


def bm25_scores(spark, sf_dir) -> DataFrame:
    d = _bm25_docs(spark, sf_dir)
    q = spark.createDataFrame([("pain", "rectal pain worse after"), ("bleeding", "rectal bleeding bright red blood"), ("loss", "weight loss fell month")], "q string, terms string")
    return retrieval.bm25(d, "doc_id", "t", q.select("q", F.split("terms", " ").alias("terms")), "q", "terms")


@query(f"WITH {_BM} SELECT q, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    """R9, R3."""
    s = bm25_scores(spark, sf_dir).withColumn("score", F.round("score", 9))
    return retrieval.topk(s, "q", "score", "doc_id", 20).select("q", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


_BM_ALL = re.sub(r"(?m)^q AS .*$", "q AS (SELECT doc_id AS q, unnest(t) AS term FROM d WHERE doc_id % 100 = 0),", _BM)


@query(f"WITH {_BM_ALL} SELECT q, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) WHERE rank <= 20")
def bm25_search(spark, sf_dir):
    """Every text whose id is divisible by 100 against all; a term counts as often as the query has it."""
    s = retrieval.bm25_search(_bm25_docs(spark, sf_dir), "doc_id", "t", F.col("doc_id") % 100 == 0, 20)
    return s.select("q", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("""
SELECT doc_id, source FROM (SELECT doc_id, source, contains(lower(text), 'melena') AS rel, max(CAST(contains(lower(text), 'melena') AS INTEGER)) OVER (PARTITION BY source) AS any_ FROM documents WHERE text IS NOT NULL) WHERE rel OR any_ = 0""")
def relevance_fallback(spark, sf_dir):
    """R8."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("s"), "source", F.contains(F.lower("text"), F.lit("melena")).alias("rel"))
    return retrieval.with_fallback(d, "s", "rel").select("doc_id", "source")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY left(text, 60) ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1")
def passage_dedup(spark, sf_dir):
    """R11."""
    return retrieval.dedup_prefix(table(spark, sf_dir, "documents").where("text is not null"), "text", [F.col("doc_id")]).select("doc_id")


@query("""
SELECT chunk_idx, coalesce(CASE WHEN json_type(raw_chunk) = 'VARCHAR' THEN raw_chunk ->> '$' END, raw_chunk ->> '$.text', raw_chunk ->> '$.chunk', raw_chunk ->> '$.sentence', raw_chunk ->> '$.content', raw_chunk ->> '$.abstract') AS text
FROM pubmed_chunks_sentences""")
def chunk_texts(spark, sf_dir):
    """S2."""
    return table(spark, sf_dir, "pubmed_chunks_sentences").select("chunk_idx", parsing.chunk_text(F.col("raw_chunk")).alias("text"))




# --- parsing and claims (X1-X10) ---------------------------------------------------------------------------------


@query("""
SELECT event_type, count(*) AS events, count(TRY_CAST(props ->> '$.k' AS DOUBLE)) AS with_k, round(avg(TRY_CAST(props ->> '$.k' AS DOUBLE)), 6) AS mean, round(stddev_samp(TRY_CAST(props ->> '$.k' AS DOUBLE)), 6) AS sd FROM events GROUP BY event_type""")
def json_props_stats(spark, sf_dir):
    """X2, A6."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count(k).alias("with_k"), F.round(F.avg(k), 6).alias("mean"), F.round(F.stddev_samp(k), 6).alias("sd"))


@query("""
SELECT pair_id, CASE WHEN y IS NOT NULL AND n IS NOT NULL THEN round(1 / (1 + exp(n - y)), 6) END AS p_yes,
  CASE WHEN y IS NOT NULL AND n IS NOT NULL THEN round(abs(2 / (1 + exp(n - y)) - 1), 6) END AS margin
FROM (SELECT pair_id, TRY_CAST(agent4_label_probs ->> '$.Yes' AS DOUBLE) AS y, TRY_CAST(agent4_label_probs ->> '$.No' AS DOUBLE) AS n FROM verge_final_pair_level)""")
def probability_audit(spark, sf_dir):
    """Two scores through the closed form; missing ones stay null."""
    of = lambda k: F.get_json_object("agent4_label_probs", f"$.{k}").try_cast("double")
    a = parsing.binary_audit(of("Yes"), of("No"))
    return table(spark, sf_dir, PAIRS).select("pair_id", F.round(a["p_yes"], 6).alias("p_yes"), F.round(a["margin"], 6).alias("margin"))


@query()
def flattened_history(spark, sf_dir):
    """Label probabilities in any stored form as names and values."""
    f = parsing.flatten(table(spark, sf_dir, PAIRS), "pair_id", "extractor_label_probs")
    return f.groupBy("parsed", F.size("fields").alias("fields")).agg(F.count("*").alias("pairs"))


_W = ", ".join(f"min(l) FILTER (feature = '{f}') AS \"{f}\"" for f in V.FINDINGS)


@query(f"SELECT _run_row_index, {_W} FROM (SELECT _run_row_index, feature, {_LABEL.format('prediction')} AS l FROM agent2_claims_pair_level) GROUP BY _run_row_index")
def claims_to_wide(spark, sf_dir):
    """X8."""
    c = table(spark, sf_dir, CLAIMS).select("_run_row_index", "feature", N.label(F.col("prediction")).alias("l"))
    return loop.claims_to_wide(c, ["_run_row_index"], "l")


@query(f"""
SELECT _run_row_index, feature, min(l) AS label FROM (SELECT _run_row_index, feature, {_LABEL.format('prediction')} AS l FROM agent2_claims_pair_level) GROUP BY 1, 2 HAVING min(l) IS NOT NULL""")
def wide_to_claims(spark, sf_dir):
    """The wide form taken apart again."""
    w = claims_to_wide(spark, sf_dir).select("_run_row_index", *(F.col(f"`{f}`").alias(f"{f} label") for f in V.FINDINGS))
    return loop.wide_to_claims(w, ["_run_row_index"], fields=("label",)).where("label is not null")


# --- loop (V1-V14) -----------------------------------------------------------------------------------------------


def _rounds(spark, sf_dir, **switches) -> DataFrame:
    """The stored labels as rounds, the last round with the stored final verdict, those before it still to be refined."""
    p = table(spark, sf_dir, PAIRS)
    labels = F.from_json("label_history", "array<string>")
    later = F.slice(labels, 2, F.greatest(F.lit(1), F.size(labels) - 1))
    n = F.size(labels) - 1
    rounds = F.when(
        n > 0, F.transform(later, lambda x, i: F.struct(x.alias("label"), F.when(i == n - 1, F.col("final_agent3_verdict")).otherwise("REFINE").alias("verdict"), (F.col("operational_failure") & (i == n - 1)).alias("error")))
    )
    return p.where("label_history is not null").select("pair_id", loop.fold_rounds(F.col("initial_agent3_verdict"), labels[0], rounds, **switches).alias("s"))


_FOLD = """
WITH h AS (SELECT pair_id, initial_agent3_verdict AS v0, final_agent3_verdict AS v1, operational_failure AS bad, from_json(label_history, '["VARCHAR"]') AS l FROM verge_final_pair_level WHERE label_history IS NOT NULL),
x AS (SELECT *, len(l) - 1 AS n, coalesce(list_first(list_filter(range(1, len(l)), lambda i: l[i + 1] = l[i])), 99) AS same FROM h),
e AS (SELECT pair_id, l, CASE WHEN v0 = 'VERIFIED' THEN 'VERIFIED' WHEN v0 IS NULL OR v0 <> 'REFINE' THEN 'INVALID_INITIAL_VERIFIER_STATE'
    WHEN same < n THEN 'LABEL_STABLE' WHEN n = 0 THEN NULL WHEN bad THEN 'REFINEMENT_ERROR' WHEN same = n THEN 'LABEL_STABLE'
    WHEN v1 = 'VERIFIED' AND n >= 5 THEN 'MAX_ROUNDS_FINAL_VERIFIED' WHEN v1 = 'VERIFIED' THEN 'VERIFIED' WHEN n >= 5 THEN 'MAX_ROUNDS_LABEL_OSCILLATION' END AS exit_reason,
  CASE WHEN v0 = 'VERIFIED' OR v0 IS NULL OR v0 <> 'REFINE' THEN 0 ELSE least(n, same) END AS rounds FROM x)
SELECT exit_reason, CAST(rounds AS INTEGER) AS rounds, count(*) AS pairs FROM e GROUP BY 1, 2"""


@query(_FOLD)
def loop_fold(spark, sf_dir):
    """V7: the bounded loop replayed as a fold."""
    s = _rounds(spark, sf_dir)
    return s.groupBy(F.col("s.exit_reason").alias("exit_reason"), F.col("s.rounds").alias("rounds")).agg(F.count("*").alias("pairs"))


@query("""
SELECT pair_id, CAST(len(l) AS INTEGER) AS steps, CAST(len(list_filter(range(1, len(l)), lambda i: l[i] <> l[i + 1])) AS INTEGER) AS flips, l[len(l)] AS last
FROM (SELECT pair_id, from_json(label_history, '["VARCHAR"]') AS l FROM verge_final_pair_level WHERE label_history IS NOT NULL)""")
def label_history(spark, sf_dir):
    """V9: flips along the labels."""
    h = table(spark, sf_dir, PAIRS).where("label_history is not null").select("pair_id", F.from_json("label_history", "array<string>").alias("l"))
    n = F.size("l")
    pairs = F.when(n > 1, F.zip_with(F.slice("l", 1, F.greatest(F.lit(0), n - 1)), F.slice("l", 2, F.greatest(F.lit(0), n - 1)), lambda a, b: (a != b).cast("int"))).otherwise(F.array().cast("array<int>"))
    return h.select("pair_id", n.alias("steps"), F.aggregate(pairs, F.lit(0), lambda s, x: s + x).alias("flips"), F.element_at("l", -1).alias("last"))


@query("""
SELECT pair_id, array_to_string(list_sort(list_filter([CASE WHEN human_review_oscillation THEN 'OSCILLATION' END, CASE WHEN operational_failure THEN 'OPERATIONAL_FAILURE' END,
  CASE WHEN agent5_confidence = 'low' THEN 'LOW_CONFIDENCE' END, CASE WHEN agent5_final_label IS NULL THEN 'NO_LABEL' END], lambda x: x IS NOT NULL)), ';') AS reasons FROM verge_final_pair_level""")
def judge_merge(spark, sf_dir):
    """Forced reasons are added to the judge's."""
    code = lambda c, k: F.when(c, F.lit(k))
    judge = F.array_compact(F.array(code(F.col("agent5_confidence") == "low", "LOW_CONFIDENCE"), code(F.col("agent5_final_label").isNull(), "NO_LABEL")))
    forced = F.array_compact(F.array(code(F.col("human_review_oscillation"), "OSCILLATION"), code(F.col("operational_failure"), "OPERATIONAL_FAILURE")))
    return table(spark, sf_dir, PAIRS).select("pair_id", F.array_join(loop.merge_reasons(judge, forced), ";").alias("reasons"))


@query("""
SELECT feature, count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS degraded, count(*) FILTER (d = 0 OR d IS NULL) AS unchanged
FROM (SELECT feature, CAST(final_agent3_verdict = 'VERIFIED' AS INTEGER) - CAST(initial_agent3_verdict = 'VERIFIED' AS INTEGER) AS d FROM verge_final_pair_level) GROUP BY feature""")
def verdict_improvement(spark, sf_dir):
    """Q22."""
    c = table(spark, sf_dir, PAIRS).select("feature", loop.verdict_change(F.col("initial_agent3_verdict"), F.col("final_agent3_verdict")).alias("c"))
    return c.groupBy("feature").agg(*(F.count_if(F.col("c") == k).alias(k.lower()) for k in ("IMPROVED", "DEGRADED", "UNCHANGED")))


# --- statistics (Q1-Q16, Q18-Q21) -----------------------------------------------------------------------------------------

_COUNTS = "count(*) FILTER (gold='Yes' AND after='Yes') AS tp, count(*) FILTER (gold='No' AND after='Yes') AS fp, count(*) FILTER (gold='Yes' AND after='No') AS fn, count(*) FILTER (gold='No' AND after='No') AS tn"


@query(f"""
WITH {_GOLD}, c AS (SELECT CASE WHEN GROUPING(feature) = 1 THEN 'ALL' ELSE feature END AS feature, {_COUNTS}, count(*) AS pairs FROM scored GROUP BY ROLLUP (feature))
SELECT feature, tp, fp, fn, tn, pairs, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
  round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy,
  round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM c""")
def confusion_by_finding(spark, sf_dir):
    """Q1-Q3: each finding and all in one pass."""
    c = stats.by_scope(scored_pairs(spark, sf_dir), "feature", [*stats.confusion(F.col("gold"), F.col("after")), F.count("*").alias("pairs")])
    m = stats.metrics(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))
    return c.select("feature", "tp", "fp", "fn", "tn", "pairs", *(F.round(m[k], 6).alias(k) for k in ("precision", "recall", "f1", "specificity", "accuracy", "mcc")))


@query(f"""
WITH {_GOLD}, n AS (SELECT nid, count(*) AS k, bool_and(after = gold) AS exact, avg(CAST(after <> gold AS INTEGER)) AS hamming, count(*) FILTER (gold = 'Yes' AND after = 'Yes') AS n_both, count(*) FILTER (gold = 'Yes' OR after = 'Yes') AS n_either
  FROM scored WHERE after IS NOT NULL GROUP BY nid)
SELECT count(*) AS notes, round(avg(CAST(exact AS INTEGER)), 6) AS exact, round(avg(hamming), 6) AS hamming, round(avg(CASE WHEN n_either = 0 THEN 1.0::DOUBLE ELSE n_both / n_either END), 6) AS jaccard FROM n WHERE k = 7""")
def note_level_scores(spark, sf_dir):
    """Q4, Q5: notes with all seven findings; an empty union counts as 1."""
    ok, yes = F.col("after") == F.col("gold"), lambda c: F.col(c) == "Yes"
    n = scored_pairs(spark, sf_dir).where("after is not null").groupBy("nid").agg(
        F.count("*").alias("k"), F.every(ok).alias("exact"), F.avg((~ok).cast("int")).alias("hamming"), F.count_if(yes("gold") & yes("after")).alias("both"), F.count_if(yes("gold") | yes("after")).alias("either")
    )
    return n.where("k = 7").agg(
        F.count("*").alias("notes"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact"), F.round(F.avg("hamming"), 6).alias("hamming"),
        F.round(F.avg(F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either"))), 6).alias("jaccard"),
    )


NOTE_REPS, PATIENT_REPS = 5000, 2000


@query()
def bootstrap_full(spark, sf_dir):
    """Q6-Q9 at the reference's B, of all notes: F1 of the final labels, its gain on the first ones, and the gain's p.

    A unit is a note or a patient by its hash, so placeholders count as well; a note without a patient is its own. Units
    are drawn as Poisson variables (the reference draws a fixed number), the same for both systems."""
    n = table(spark, sf_dir, GOLD).groupBy(N.normalize_id(F.col("NOTE_ID")).alias("nid")).agg(F.min(F.nullif(N.normalize_id(F.col("PAT_ID")), F.lit(""))).alias("pat"))
    s = scored_pairs(spark, sf_dir).where("before is not null and after is not null").join(n, "nid", "left")
    cols = [f"{w}_{c}" for w in ("after", "before") for c in ("tp", "fp", "fn")]
    out = []
    for name, unit, reps in (("note", F.col("nid"), NOTE_REPS), ("patient", F.coalesce("pat", F.concat(F.lit("note "), "nid")), PATIENT_REPS)):
        counts = s.withColumn("unit", unit).groupBy("unit", "feature").agg(*(c.alias(a) for w in ("after", "before") for c, a in zip(stats.confusion(F.col("gold"), F.col(w))[:3], [x for x in cols if x.startswith(w)])))
        b = stats.bootstrap_hashed(counts, "unit", "feature", cols, reps)
        f1 = lambda w: F.try_divide(2.0 * F.col(f"{w}_tp"), 2.0 * F.col(f"{w}_tp") + F.col(f"{w}_fp") + F.col(f"{w}_fn"))
        f = b.select("feature", f1("after").alias("f1"), (f1("after") - f1("before")).alias("d"))
        g = f.groupBy("feature").agg(stats.percentile_ci(F.col("f1")).alias("ci"), stats.percentile_ci(F.col("d")).alias("cd"), stats.bootstrap_p(F.col("d")).alias("p"), F.count("*").alias("reps"))
        ends = [F.round(F.col(c)[i], 6).alias(a) for c, i, a in (("ci", 0, "low"), ("ci", 1, "high"), ("cd", 0, "gain_low"), ("cd", 1, "gain_high"))]
        out.append(g.select(F.lit(name).alias("unit"), "feature", *ends, F.round("p", 6).alias("p"), "reps"))
    return out[0].unionByName(out[1])


_LF = "coalesce(list_sum(list_transform(range(1, {0} + 1), lambda i: ln(i))), 0.0)"


@query(f"""
WITH {_GOLD}, d AS (SELECT feature, count(*) FILTER (before <> gold AND after = gold) AS b, count(*) FILTER (before = gold AND after <> gold) AS c FROM scored WHERE before IS NOT NULL GROUP BY feature),
p AS (SELECT feature, b, c, CASE WHEN b + c > 0 THEN least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp({_LF.format('(b + c)')} - {_LF.format('i')} - {_LF.format('(b + c - i)')} - (b + c) * ln(2.0))))) END AS p FROM d),
h AS (SELECT feature, p, count(*) OVER () AS m, row_number() OVER (ORDER BY round(p, 9), feature) AS r FROM p WHERE p IS NOT NULL)
SELECT p.feature, b, c, round(p.p, 6) AS p, round(least(1.0::DOUBLE, max((m - r + 1) * h.p) OVER (ORDER BY r)), 6) AS p_holm FROM p JOIN h USING (feature)""")
def mcnemar_holm(spark, sf_dir):
    """Q10, Q11: exact paired tests by finding, adjusted step by step."""
    ok0, ok1 = F.col("before") == F.col("gold"), F.col("after") == F.col("gold")
    d = scored_pairs(spark, sf_dir).where("before is not null").groupBy("feature").agg(F.count_if(~ok0 & ok1).alias("b"), F.count_if(ok0 & ~ok1).alias("c"))
    p = d.withColumn("p", stats.mcnemar(F.col("b"), F.col("c"))).withColumn("family", F.lit(1)).withColumn("po", F.round("p", 9))
    h = stats.holm(p, "po", ["family"], ["feature"])
    return h.select("feature", "b", "c", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query(f"""
WITH {_GOLD}, s AS (SELECT feature, CASE WHEN isnan(bleu) THEN NULL ELSE bleu END AS x, gold = 'Yes' AS pos FROM scored), k AS (SELECT * FROM s WHERE x IS NOT NULL AND pos IS NOT NULL),
r AS (SELECT feature, pos, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r FROM k), g AS (SELECT feature, sum(CASE WHEN pos THEN r END) AS s, count(*) FILTER (pos) AS a, count(*) FILTER (NOT pos) AS b FROM r GROUP BY feature)
SELECT feature, CASE WHEN a > 0 AND b > 0 THEN round(CAST(s - a * (a + 1) / 2 AS DOUBLE) / (a * b), 6) END AS auroc, a AS n_pos, b AS n_neg FROM g""")
def auroc(spark, sf_dir):
    """Q13: average ranks from the counts of distinct scores."""
    s = scored_pairs(spark, sf_dir).select("feature", F.when(~F.isnan("bleu"), F.col("bleu")).alias("x"), (F.col("gold") == "Yes").alias("pos"))
    return stats.auroc(s, "x", "pos", ["feature"]).select("feature", F.round("auroc", 6).alias("auroc"), "n_pos", "n_neg")


@query(f"""
WITH s AS (SELECT feature, confidence AS bin, {_LABEL.format('prediction')} AS l, coalesce(has_evidence, false) AS ok FROM agent2_claims_pair_level), p AS (SELECT * FROM s WHERE l = 'Yes' AND bin IS NOT NULL),
g AS (SELECT CASE WHEN GROUPING(feature) = 1 THEN 'ALL' ELSE feature END AS feature, bin, count(*) AS n, round(avg(CAST(ok AS INTEGER)), 6) AS rate FROM p GROUP BY GROUPING SETS ((feature, bin), (bin))),
sc AS (SELECT f AS feature, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT feature AS f FROM s UNION SELECT 'ALL'), (SELECT unnest(range(1, 6)) AS b))
SELECT sc.feature, sc.bin, coalesce(n, 0) AS n, rate FROM sc LEFT JOIN g ON g.feature = sc.feature AND g.bin = sc.bin""")
def calibration_bins(spark, sf_dir):
    """Q16: bins 1 to 5 for each finding and all; empty bins stay."""
    c = table(spark, sf_dir, CLAIMS).select("feature", F.col("confidence").cast("int").alias("bin"), N.label(F.col("prediction")).alias("l"), F.coalesce("has_evidence", F.lit(False)).cast("int").alias("ok"))
    p = c.where("l = 'Yes' and bin is not null").select(F.explode(F.array(F.col("feature"), F.lit("ALL"))).alias("feature"), "bin", "ok")
    g = p.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("rate"))
    names = spark.createDataFrame([(f,) for f in (*V.FINDINGS, "ALL")], "feature string").select("feature", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("bin"))
    return names.join(g, ["feature", "bin"], "left").select("feature", "bin", F.coalesce("n", F.lit(0)).alias("n"), "rate")


@query(f"""
WITH {_GOLD}, s AS (SELECT CASE WHEN failed OR exit_reason IN ('MAX_ROUNDS_LABEL_OSCILLATION','REFINEMENT_ERROR') THEN 'review' ELSE 'clear' END AS flag, after <> gold AS wrong FROM scored WHERE after IS NOT NULL)
SELECT flag, count(*) AS n, count(*) FILTER (wrong) AS errors, round(count(*) FILTER (wrong) / count(*), 6) AS rate FROM s GROUP BY flag""")
def review_errors(spark, sf_dir):
    """Q19."""
    flag = F.when(F.col("failed") | F.col("exit_reason").isin("MAX_ROUNDS_LABEL_OSCILLATION", "REFINEMENT_ERROR"), "review").otherwise("clear")
    s = scored_pairs(spark, sf_dir).where("after is not null").select(flag.alias("flag"), (F.col("after") != F.col("gold")).alias("wrong"))
    return s.groupBy("flag").agg(F.count("*").alias("n"), F.count_if("wrong").alias("errors"), F.round(F.count_if("wrong") / F.count("*"), 6).alias("rate"))


@query(f"""
WITH {_GOLD} SELECT count(*) AS labelled, count(after) AS predicted, count(*) FILTER (before = 'No') AS negative, count(*) FILTER (before = 'No' AND after = 'Yes') AS recovered,
  count(*) FILTER (before = 'No' AND after = 'Yes' AND gold = 'Yes') AS correct FROM scored""")
def recovery_funnel(spark, sf_dir):
    """Q20: five stages in one pass."""
    no = F.col("before") == "No"
    rec = no & (F.col("after") == "Yes")
    return scored_pairs(spark, sf_dir).agg(F.count("*").alias("labelled"), F.count("after").alias("predicted"), F.count_if(no).alias("negative"), F.count_if(rec).alias("recovered"), F.count_if(rec & (F.col("gold") == "Yes")).alias("correct"))


@query("""
SELECT pair_id, feature, label FROM (SELECT pair_id, feature, final_loop_prediction AS label, row_number() OVER (PARTITION BY feature, final_loop_prediction ORDER BY (pair_id * 2654435761) % 1000003, pair_id) AS rn FROM verge_final_pair_level)
WHERE rn <= 25""")
def stratified_sample(spark, sf_dir):
    """Q21: exactly 25 of each stratum (the feature is a sample), by an arithmetic order."""
    p = table(spark, sf_dir, PAIRS).select("pair_id", "feature", F.col("final_loop_prediction").alias("label"))
    return stats.stratified(p, ["feature", "label"], 25, [(F.col("pair_id") * F.lit(2654435761)) % 1000003, F.col("pair_id")])


@query(f"""
WITH {_GOLD} SELECT feature, round(avg(CAST(after = gold AS INTEGER)) - avg(CAST(before = gold AS INTEGER)), 6) AS delta, count(*) AS n FROM scored WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY feature""")
def paired_delta(spark, sf_dir):
    """Q12: two systems on the rows both have."""
    s = scored_pairs(spark, sf_dir).where("before is not null and after is not null")
    ok = lambda c: F.avg((F.col(c) == F.col("gold")).cast("int"))
    return s.groupBy("feature").agg(F.round(ok("after") - ok("before"), 6).alias("delta"), F.count("*").alias("n"))


@query("""
SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    """The batch form of the windowed stream."""
    from ..streaming.wrap import windowed_counts

    w = windowed_counts(table(spark, sf_dir, "events"))
    return w.select(F.col("start").cast("string").alias("start"), "event_type", "n")


@query("""
SELECT event_type, CAST(ts AS DATE) IS NOT NULL AS dated, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY GROUPING SETS ((1, 2), (2))""".replace("GROUPING SETS ((1, 2), (2))", "GROUPING SETS ((event_type, CAST(ts AS DATE) IS NOT NULL), (CAST(ts AS DATE) IS NOT NULL))"))
def event_audit(spark, sf_dir):
    """A8 on events: by type, and all."""
    e = table(spark, sf_dir, "events").withColumn("dated", F.col("ts").isNotNull())
    aggs = [F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value")]
    return e.groupBy("event_type", "dated").agg(*aggs).unionByName(e.groupBy("dated").agg(*aggs).withColumn("event_type", F.lit(None).cast("string")))


@query()
def recovery_audit(spark, sf_dir):
    """Mentions tried as missed evidence, by outcome."""
    from ..operators.recovery import recovery_scan

    _, audit = recovery_scan(spread(table(spark, sf_dir, NOTES)), "_run_row_index", "Clean_note_text", V.ALIASES)
    return audit.select("feature", "accepted", F.explode_outer("failures").alias("failure")).groupBy("feature", "accepted", "failure").agg(F.count("*").alias("mentions"))


