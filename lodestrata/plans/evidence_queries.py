"""Queries of retrieval, evidence, recovery, parsing and sources (R, E, J9, P2, P7, P13, P17, X, S, K, H), with their DuckDB forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import normalize as N
from ..functions import policy as P
from ..functions import structure as S
from ..functions import vocabulary as V
from ..operators import loop, parsing, recovery, retrieval, stats
from ..operators import text as T
from ..session import ensure_checkpoint_dir, spread
from ..sources import io
from ..sources.tables import table
from .core_queries import _GOLD, CLAIMS, NOTES, PAIRS, scored_pairs
from .rule_queries import _AFTER, _BEFORE, _CLASS, _LEX, _SRC, _any, _fold, _label, _strip, mentions_sql
from .score_queries import _BM, _bm25_docs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- hybrid retrieval (R6, R7, R12) -------------------------------------------------------------------------------

_BM_SAME = _BM[: _BM.rindex("q AS (")] + "q AS (SELECT doc_id AS q, unnest(t) AS term FROM d WHERE doc_id % 100 = 0),\n" + _BM[_BM.rindex("b AS (") :]
_HYBRID = f"""{_BM_SAME},
r1 AS (SELECT q, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b),
v AS (SELECT a.vec_id AS q, b.vec_id AS doc_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
r2 AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM v),
u AS (SELECT q, doc_id, 0.0::DOUBLE AS cosine, 0.5::DOUBLE / (60 + rank) AS w FROM r1 WHERE rank <= 32 UNION ALL SELECT q, doc_id, score AS cosine, 0.5::DOUBLE / (60 + rank) AS w FROM r2 WHERE rank <= 32)"""


def hybrid_lists(spark, sf_dir) -> DataFrame:
    """The 32 best of the term index and of the vectors for each id divisible by 100 that a query has, with half a weight each."""
    a = retrieval.bm25_product(_bm25_docs(spark, sf_dir), "doc_id", "t", F.col("doc_id") % 100 == 0, 32)
    b = retrieval.dense_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 32).withColumnRenamed("vec_id", "doc_id")
    one = a.select("q", "doc_id", F.lit(0.0).alias("score"), "rank")
    return one.unionByName(b.select("q", "doc_id", "score", "rank"))


@query(f"""
WITH {_HYBRID}, f AS (SELECT q, doc_id, sum(w) AS rrf, max(cosine) AS best FROM u GROUP BY q, doc_id), g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 12) DESC, best DESC, doc_id) AS rank FROM f)
SELECT q, doc_id, round(rrf, 9) AS rrf, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 20""")
def hybrid_rrf(spark, sf_dir):
    """Terms and vectors fused with equal weights, for each id divisible by 100."""
    f = retrieval.rrf(hybrid_lists(spark, sf_dir), "q", "doc_id", weight=F.lit(0.5), keep=20)
    return f.select("q", "doc_id", F.round("rrf", 9).alias("rrf"), F.col("rank").cast("int").alias("rank"))


@query(f"""
WITH {_HYBRID}, f AS (SELECT doc_id, sum(w) AS rrf, max(cosine) AS best FROM u GROUP BY doc_id), g AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, best DESC, doc_id) AS rank FROM f)
SELECT doc_id, round(rrf, 9) AS rrf, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 20""")
def global_rrf(spark, sf_dir):
    """The same summed over all queries."""
    f = retrieval.rrf(hybrid_lists(spark, sf_dir).withColumn("all", F.lit(1)), "all", "doc_id", weight=F.lit(0.5), keep=20)
    return f.select("doc_id", F.round("rrf", 9).alias("rrf"), F.col("rank").cast("int").alias("rank"))


_TIERS = (("VERY_LOW", r"(?i)\b(?:case report|anecdot\w*)\b"), ("LOW", r"(?i)\b(?:tolerates|works as)\b"), ("HIGH", r"(?i)\b(?:colonoscopy|abdominal CT)\b"), ("MODERATE", r"(?i)\b(?:reviewed|history of)\b"))
_CHUNK = "(SELECT chunk_idx, coalesce(CASE WHEN json_type(raw_chunk) = 'VARCHAR' THEN raw_chunk ->> '$' END, raw_chunk ->> '$.text', raw_chunk ->> '$.chunk', raw_chunk ->> '$.sentence', raw_chunk ->> '$.content', raw_chunk ->> '$.abstract') AS text, raw_chunk ->> '$.pmid' AS pmid FROM pubmed_chunks_sentences)"
_PASSAGES = f"""lex(feature, alias, ord) AS (VALUES {_LEX}), ch AS {_CHUNK}, p0 AS (SELECT feature, chunk_idx, text, count(*) / 10.0::DOUBLE AS best FROM ch JOIN lex ON contains(lower(text), alias) GROUP BY 1, 2, 3),
p AS (SELECT *, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY feature ORDER BY best DESC, chunk_idx)) AS rrf FROM p0)"""


def chunks(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "pubmed_chunks_sentences")
    return c.select("chunk_idx", parsing.chunk_text(F.col("raw_chunk")).alias("text"), F.get_json_object("raw_chunk", "$.pmid").alias("pmid"))


def passages(spark, sf_dir) -> DataFrame:
    """(feature, chunk_idx, text, best, rrf): chunks that name a finding, the more of its aliases the better."""
    low = F.lower("text")
    n = lambda terms: sum((F.contains(low, F.lit(a)).cast("int") for a in dict.fromkeys(terms)), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), (n(terms) / 10.0).alias("best")) for f, terms in V.ALIASES.items())))
    d = chunks(spark, sf_dir).select("chunk_idx", "text", each.alias("e")).select("e.feature", "chunk_idx", "text", "e.best").where("best > 0")
    from pyspark.sql import Window

    return d.withColumn("rrf", 1.0 / (60 + F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("best"), "chunk_idx"))))


@query(
    f"WITH {_PASSAGES}, t AS (SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _TIERS)
    + " ELSE 'UNCLASSIFIED' END AS tier FROM p), o AS (SELECT *, coalesce(list_position(['HIGH', 'MODERATE', 'UNCLASSIFIED'], tier), 0) AS k FROM t) "
    "SELECT feature, chunk_idx, tier, k > 0 AS eligible, k > 0 AND row_number() OVER (PARTITION BY feature, k > 0 ORDER BY k, round(rrf, 12) DESC, best DESC, chunk_idx) <= 2 AS included FROM o"
)
def tier_selection(spark, sf_dir):
    """The two best passages of a finding from the tiers kept, and the audit of all."""
    d = passages(spark, sf_dir).withColumn("tier", P.source_tier(F.col("text"), _TIERS))
    return retrieval.select_by_tier(d, "feature", "tier", "rrf", "best", "chunk_idx").select("feature", "chunk_idx", "tier", "eligible", "included")


# --- graded evidence (E1-E5, J9, R13, R14, R15) -------------------------------------------------------------------

_CH = f"ch AS {_CHUNK}, cm AS (SELECT chunk_idx, CASE WHEN pmid IS NULL THEN NULL WHEN right(pmid, 1) IN ('0', '5') THEN 'PMID_' || pmid ELSE 'S' || right(pmid, 2) END AS study_id, pmid FROM ch)"
_ST = "st AS (SELECT DISTINCT study_id, pmid, 'B' || right(pmid, 1) AS body_id, right(pmid, 1) <> '7' AS include FROM cm WHERE pmid IS NOT NULL)"
_JUDGE = "CASE ({d} + {i}) % 4 WHEN 1 THEN 'serious' WHEN 3 THEN 'very serious' ELSE 'not serious' END"
_BODIES = "bd AS (SELECT body_id, CAST(right(body_id, 1) AS INTEGER) AS d FROM (SELECT DISTINCT body_id FROM st))"
_DUE = "greatest(1, least(4, 4 - (" + " + ".join("CASE (d + {}) % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END".format(i * 2) for i in range(2)) + ") + d % 2))"


def evidence_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk map, study map, profiles) from the chunks' own PMIDs: the test tables have no graded evidence of their own, so
    a body's judgments follow from the last digit of its studies' PMIDs."""
    c = chunks(spark, sf_dir)
    last = F.right("pmid", F.lit(1))
    cm = c.select("chunk_idx", F.when(F.col("pmid").isNull(), F.lit(None).cast("string")).when(last.isin("0", "5"), F.concat(F.lit("PMID_"), "pmid")).otherwise(F.concat(F.lit("S"), F.right("pmid", F.lit(2)))).alias("study_id"), "pmid")
    st = cm.where("pmid is not null").select("study_id", "pmid", F.concat(F.lit("B"), F.right("pmid", F.lit(1))).alias("body_id"), (F.right("pmid", F.lit(1)) != "7").alias("include")).distinct()
    d = F.right("body_id", F.lit(1)).cast("int")
    judge = lambda i: F.when((d + i) % 4 == 1, "serious").when((d + i) % 4 == 3, "very serious").otherwise("not serious")
    fields = [(judge(i * 2) if i < 2 else F.lit("not serious")).alias(k) for i, k in enumerate(recovery.DOMAINS)]
    reasons = [F.when((d == 4) & (F.lit(i) == 0), "").otherwise("stated").alias(f"{k}_rationale") for i, k in enumerate(recovery.DOMAINS)]
    due = F.greatest(F.lit(1), F.least(F.lit(4), 4 - sum((F.when((d + i * 2) % 4 == 1, 1).when((d + i * 2) % 4 == 3, 2).otherwise(0) for i in range(2)), F.lit(0)) + d % 2))
    stated = F.when(d == 6, "HIGH").otherwise(retrieval.certainty_name(due))
    profiles = st.select("body_id").distinct().select(
        "body_id", F.when(d == 8, "Headache").otherwise(F.element_at(F.array(*map(F.lit, V.FINDINGS)), d % 7 + 1)).alias("finding"), F.lit("4").alias("start"), (d % 2).cast("string").alias("upgrade"), *fields, *reasons,
        stated.alias("final"), due.alias("score"), F.when(d % 2 == 0, "internal").otherwise("published").alias("protocol"), F.when(d < 5, "review").otherwise("guideline").alias("origin"),
    )
    return cm, st, profiles


_NAMES4 = "['VERY_LOW', 'LOW', 'MODERATE', 'HIGH']"
_FIND = "[" + ", ".join(f"'{f}'" for f in V.FINDINGS) + "]"


@query(f"""
WITH {_CH}, {_ST}, {_BODIES}, pr AS (SELECT body_id, d, CASE WHEN d = 8 THEN 'Headache' ELSE {_FIND}[d % 7 + 1] END AS finding, {_DUE} AS due, CASE WHEN d = 6 THEN 'HIGH' ELSE {_NAMES4}[{_DUE}] END AS final, {_JUDGE.format(d='d', i=0)} AS j0 FROM bd)
SELECT body_id, array_to_string(list_filter([CASE WHEN j0 <> 'not serious' AND d = 4 THEN 'RISK_OF_BIAS_WITHOUT_RATIONALE' END, CASE WHEN finding NOT IN ({', '.join(f"'{f}'" for f in V.FINDINGS)}) THEN 'FINDING_UNKNOWN' END,
  CASE WHEN list_position({_NAMES4}, final) <> due THEN 'CERTAINTY_DOES_NOT_FOLLOW' END], lambda x: x IS NOT NULL), ';') AS violations FROM pr""")
def profile_checks(spark, sf_dir):
    """E1, E2, S5."""
    _, _, profiles = evidence_tables(spark, sf_dir)
    return recovery.profile_violations(profiles, V.FINDINGS).select("body_id", F.array_join("violations", ";").alias("violations"))


@query(f"WITH {_CH}, {_ST}, {_BODIES} SELECT CASE WHEN d % 2 = 0 THEN 'internal' ELSE 'published' END AS protocol, CASE WHEN d < 5 THEN 'review' ELSE 'guideline' END AS origin, count(*) AS n FROM bd GROUP BY 1, 2")
def profile_metadata(spark, sf_dir):
    """E5."""
    return recovery.profile_counts(evidence_tables(spark, sf_dir)[2])


_RESOLVED = """rs AS (SELECT DISTINCT chunk_idx, body_id FROM (SELECT chunk_idx, body_id FROM (SELECT chunk_idx, unnest(list_filter(list_distinct([study_id, 'PMID_' || pmid]), lambda x: x IS NOT NULL)) AS study_id FROM cm WHERE pmid IS NOT NULL) JOIN st USING (study_id)
  UNION ALL SELECT chunk_idx, body_id FROM cm JOIN st USING (pmid)))"""


@query(f"WITH {_CH}, {_ST}, {_RESOLVED} SELECT chunk_idx, body_id FROM rs")
def chunk_bodies(spark, sf_dir):
    """J9."""
    cm, st, _ = evidence_tables(spark, sf_dir)
    return retrieval.resolve_chunks(cm, st)


@query(f"""
WITH {_CH}, {_ST}, {_BODIES}, inc AS (SELECT * FROM st WHERE include) SELECT body_id, 'NO_INCLUDED_STUDY' AS violation FROM bd WHERE body_id NOT IN (SELECT body_id FROM inc)
UNION ALL SELECT body_id, 'NO_CHUNK_RESOLVES' FROM bd WHERE body_id NOT IN (SELECT body_id FROM inc JOIN cm USING (study_id))""")
def provenance_checks(spark, sf_dir):
    """E3."""
    cm, st, profiles = evidence_tables(spark, sf_dir)
    return retrieval.provenance_violations(profiles.select("body_id"), st, cm)


_GRADED = f"""{_CH}, {_ST}, {_BODIES}, {_RESOLVED}, {_PASSAGES.replace('ch AS ' + _CHUNK + ', ', '')},
m AS (SELECT chunk_idx, min(due) AS certainty FROM rs JOIN (SELECT body_id, {_DUE} AS due FROM bd) USING (body_id) GROUP BY 1),
k AS (SELECT feature, chunk_idx, text, certainty, row_number() OVER (PARTITION BY feature ORDER BY (certainty IS NOT NULL) DESC, certainty DESC NULLS LAST, round(rrf, 12) DESC, best DESC, chunk_idx) AS pick FROM p LEFT JOIN m USING (chunk_idx))"""


def graded(spark, sf_dir) -> DataFrame:
    cm, st, profiles = evidence_tables(spark, sf_dir)
    bodies = retrieval.resolve_chunks(cm, st).join(profiles.select("body_id", "score"), "body_id")
    return retrieval.select_evidence(retrieval.annotate(passages(spark, sf_dir), bodies), "feature")


@query(f"WITH {_GRADED} SELECT feature, chunk_idx, CAST(certainty AS INTEGER) AS certainty, CAST(pick AS INTEGER) AS pick FROM k WHERE pick <= 2")
def evidence_select(spark, sf_dir):
    """The least certainty of a chunk's bodies of evidence, then the two best passages of a finding."""
    return graded(spark, sf_dir).where("kept").select("feature", "chunk_idx", F.col("certainty").cast("int").alias("certainty"), F.col("pick").cast("int").alias("pick"))


@query(f"WITH {_GRADED} SELECT feature, string_agg('[' || pick || '] (' || coalesce({_NAMES4}[certainty], 'UNMAPPED') || ') ' || text, chr(10) ORDER BY pick) AS evidence FROM k WHERE pick <= 2 GROUP BY feature")
def evidence_text(spark, sf_dir):
    """The kept passages as one numbered text a finding."""
    d = graded(spark, sf_dir).where("kept").withColumn("tier", retrieval.certainty_name(F.col("certainty")))
    return recovery.rendered(d, "feature", "pick", "text", "tier")


_MODES = (("full", 6000), ("fewer_aliases", 4000), ("no_concepts", 2500), ("one_passage", 1200), ("note_only", 300))


@query(
    "WITH m(ord, mode, extra) AS (VALUES " + ", ".join(f"({i}, '{m}', {x})" for i, (m, x) in enumerate(_MODES)) + "), "
    "c AS (SELECT _run_row_index, ord, mode, CAST(ceil(length(Clean_note_text) / 4.0) AS BIGINT) + extra + 1536 + 256 AS cost FROM rebuilt_notes_by_noteid, m WHERE Clean_note_text IS NOT NULL) "
    "SELECT _run_row_index, mode, cost FROM c WHERE cost <= 8192 QUALIFY row_number() OVER (PARTITION BY _run_row_index ORDER BY ord) = 1"
)
def context_budget(spark, sf_dir):
    """The first of five modes whose prompt, output and margin fit the context; notes that fit none are missing."""
    modes = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(m).alias("mode"), F.lit(x).alias("extra")) for i, (m, x) in enumerate(_MODES))))
    d = table(spark, sf_dir, NOTES).where("Clean_note_text is not null").select("_run_row_index", F.ceil(F.length("Clean_note_text") / 4).alias("n"), modes.alias("m"))
    cost = d.select("_run_row_index", "m.ord", "m.mode", (F.col("n") + F.col("m.extra") + 1536 + 256).alias("cost"))
    return retrieval.first_fit(cost, "_run_row_index", "ord", "cost", 8192).select("_run_row_index", "mode", "cost")


@query("WITH lex(feature, alias, ord) AS (VALUES " + _LEX + ") SELECT feature, feature || ': ' || string_agg(alias, ', ' ORDER BY ord) AS line FROM lex WHERE ord < 15 GROUP BY feature")
def alias_section(spark, sf_dir):
    """R16."""
    return recovery.alias_section(T.lexicon(spark, V.ALIASES), 15)


_EXTRA = ", ".join(f"('{f}', [{', '.join(repr(t) for t in terms[:3])}])" for f, terms in V.RETRIEVAL_TERMS.items())


@query(f"""
WITH {mentions_sql(_SRC)}, x(feature, broader) AS (VALUES {_EXTRA}), t AS (SELECT r, feature, list_sort(list(DISTINCT alias))[1:2] AS terms FROM m GROUP BY r, feature),
v AS (SELECT r, feature, lower(feature) AS base, array_to_string([lower(feature)] || list_filter(terms, lambda y: y <> lower(feature)), ' ') AS note, array_to_string([lower(feature)] || broader, ' ') AS onto FROM t JOIN x USING (feature))
SELECT r AS _run_row_index, feature, base || '|' || note || '|' || onto AS variants FROM v WHERE note <> base""")
def query_variants(spark, sf_dir):
    """The three queries of a note's finding that the note has a word of its own for."""
    m = T.mentions(spread(table(spark, sf_dir, NOTES)), "_run_row_index", "Clean_note_text", V.ALIASES).groupBy("_run_row_index", "feature").agg(F.slice(F.array_sort(F.collect_set("alias")), 1, 2).alias("terms"))
    broader = F.lit(None).cast("array<string>")
    for f, terms in V.RETRIEVAL_TERMS.items():
        broader = F.when(F.col("feature") == f, F.array(*map(F.lit, terms[:3]))).otherwise(broader)
    v = recovery.query_variants(F.col("feature"), F.col("terms"), broader, F.array().cast("array<string>"))
    d = m.select("_run_row_index", "feature", v.alias("v")).where(F.exists("v", lambda x: x["name"] == "note_anchored"))
    return d.select("_run_row_index", "feature", F.array_join(F.transform("v", lambda x: x["query"]), "|").alias("variants"))


# --- recovery and assertion (P2, P7, P13, P17) --------------------------------------------------------------------


_QSRC = "SELECT claim_id AS r, translate(lower(evidence_quote), chr(1) || chr(2), '  ') AS t FROM agent2_claims_pair_level WHERE evidence_quote <> ''"
_CUE = "list_distinct(list_filter([" + ", ".join(
    [f"CASE WHEN regexp_matches(bef, '\\b{c}\\b') THEN '{c}' END" for c in V.QUOTE_CUES_BEFORE] + [f"CASE WHEN regexp_matches(aft, '\\b{c}\\b') THEN '{c}' END" for c in V.QUOTE_CUES_AFTER]
) + "], lambda x: x IS NOT NULL))"


@query(f"""
WITH {mentions_sql(_QSRC).replace('AS (VALUES ' + _LEX + ')', 'AS (VALUES ' + _LEX + ', ' + ', '.join(f"('{f}', '{f.lower()}', 999)" for f in V.FINDINGS if f.lower() not in V.ALIASES[f]) + ')')},
w AS (SELECT r, string_agg({_BEFORE.format(n=40)}, chr(10)) AS bef, string_agg({_AFTER.format(n=40)}, chr(10)) AS aft FROM m JOIN agent2_claims_pair_level c ON c.claim_id = r AND c.feature = m.feature GROUP BY r),
n AS (SELECT r, len({_CUE}) AS n FROM w)
SELECT claim_id, CASE WHEN coalesce(evidence_quote, '') = '' THEN 'UNKNOWN' WHEN n IS NULL THEN 'NO_TARGET_FOUND' WHEN n >= 2 THEN 'POSSIBLE_DOUBLE_NEGATION' WHEN n = 1 THEN 'NEGATED' ELSE 'AFFIRMED' END AS class FROM agent2_claims_pair_level LEFT JOIN n ON r = claim_id""")
def quote_negation(spark, sf_dir):
    """Assertion of each quotation."""
    return table(spark, sf_dir, CLAIMS).select("claim_id", P.quote_negation(F.col("evidence_quote"), F.col("feature"), V.ALIASES).alias("class"))


@query()
def family_composites(spark, sf_dir):
    """Family histories told without an alias."""
    return S.family_composites(spread(table(spark, sf_dir, NOTES)), "_run_row_index", "Clean_note_text")


@query()
def recovered_claims(spark, sf_dir):
    """The "No" claims for which the recovery scan found evidence in their note, as overridden."""
    accepted, _ = recovery.recovery_scan(spread(table(spark, sf_dir, NOTES)), "_run_row_index", "Clean_note_text", V.ALIASES)
    c = table(spark, sf_dir, CLAIMS).where(N.label(F.col("prediction")) == "No")
    j = c.join(accepted.select("_run_row_index", "feature", "alias", "quote"), ["_run_row_index", "feature"])
    return j.select("claim_id", S.contradiction(F.lit("No"), F.lit(True), F.lit(12.0)).alias("label"), F.lit(3).alias("confidence"), "alias", "quote")


_CONTRA = f"""c AS (SELECT _run_row_index, feature, min_by({_label('prediction')}, claim_id) AS l FROM agent2_claims_pair_level GROUP BY 1, 2), tt AS (SELECT r, feature, count(DISTINCT alias) AS terms, count(*) AS n FROM m GROUP BY 1, 2)"""


@query(f"WITH {mentions_sql(_SRC)}, {_CONTRA} SELECT _run_row_index, feature, CASE WHEN l = 'No' AND terms >= 2 THEN 'Yes' ELSE l END AS label FROM c LEFT JOIN tt ON tt.r = c._run_row_index AND tt.feature = c.feature".replace("SELECT _run_row_index, feature, CASE", "SELECT _run_row_index, c.feature, CASE"))
def contradictions(spark, sf_dir):
    """P17, the form of two terms or more: a "No" against a note that names the finding in two ways becomes a "Yes"."""
    c = table(spark, sf_dir, CLAIMS).groupBy("_run_row_index", "feature").agg(F.min_by(N.label(F.col("prediction")), "claim_id").alias("l"))
    m = T.mentions(spread(table(spark, sf_dir, NOTES)), "_run_row_index", "Clean_note_text", V.ALIASES).groupBy("_run_row_index", "feature").agg(F.count_distinct("alias").alias("terms"))
    j = c.join(m, ["_run_row_index", "feature"], "left")
    return j.select("_run_row_index", "feature", S.contradiction(F.col("l"), F.coalesce(F.col("terms") >= 2, F.lit(False)), F.lit(12.0)).alias("label"))


# --- statistics (Q14, Q15) ----------------------------------------------------------------------------------------


@query(f"""
WITH {_GOLD}, s AS (SELECT feature, CASE WHEN isnan(bleu) THEN NULL ELSE bleu END AS x, gold = 'Yes' AS pos FROM scored), k AS (SELECT * FROM s WHERE x IS NOT NULL),
r AS (SELECT feature, pos, x, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY feature, x) AS t FROM k),
g AS (SELECT feature, count(*) FILTER (pos) AS n1, count(*) FILTER (NOT pos) AS n2, sum(rk) FILTER (pos) AS s, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY feature), u AS (SELECT *, s - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 + n2 AS n FROM g)
SELECT feature, n1, n2, round(u, 3) AS u, round(greatest(0.0::DOUBLE, abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5::DOUBLE) / sqrt(n1 * n2 / 12.0::DOUBLE * ((n + 1) - ties / (CAST(n AS DOUBLE) * (n - 1)))), 6) AS z FROM u""")
def mann_whitney(spark, sf_dir):
    """Q15: U and z of scores of gold positives against negatives."""
    s = scored_pairs(spark, sf_dir).select("feature", F.when(~F.isnan("bleu"), F.col("bleu")).alias("x"), (F.col("gold") == "Yes").alias("pos"))
    m = stats.mann_whitney(s, "x", "pos", ["feature"])
    return m.select("feature", "n1", "n2", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


_SPEAR = """
WITH k AS (SELECT feature, final_bleu AS x, final_rouge_l AS y FROM verge_final_pair_level WHERE final_bleu IS NOT NULL AND NOT isnan(final_bleu) AND final_rouge_l IS NOT NULL AND NOT isnan(final_rouge_l)),
r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM k),
c AS (SELECT feature, count(*) AS n, corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) AS rho FROM r GROUP BY feature)"""


def _spearman(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, PAIRS).select("feature", *(F.when(~F.isnan(c), F.col(c)).alias(a) for c, a in (("final_bleu", "x"), ("final_rouge_l", "y"))))
    return stats.spearman(p, "x", "y", ["feature"])


@query(_SPEAR + " SELECT feature, n, round(rho, 6) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 5) AS t FROM c")
def spearman(spark, sf_dir):
    """Q14: rank correlation and its t."""
    return _spearman(spark, sf_dir).select("feature", "n", F.round("rho", 6).alias("rho"), F.round(F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))), 5).alias("t"))


@query()
def spearman_p(spark, sf_dir):
    """Q14: the p value, by Student's distribution, which SQL lacks."""
    return _spearman(spark, sf_dir).select("feature", F.round(stats.spearman_p(F.col("rho"), F.col("n")), 9).alias("p"))


# --- parsing and small helpers (X4, X5, S9, H5, H11, H16, H20, H22, H23) --------------------------------------------


@query("""
WITH p AS (SELECT pair_id, TRY_CAST(agent4_label_probs AS JSON) AS j FROM verge_final_pair_level)
SELECT pair_id, array_to_string(list_filter([CASE WHEN j ->> '$.Yes' IS NULL THEN 'MISSING:Yes' END, CASE WHEN j ->> '$.No' IS NULL THEN 'MISSING:No' END, CASE WHEN j ->> '$.label' IS NULL THEN 'MISSING:label' END], lambda x: x IS NOT NULL), ';') AS issues,
  coalesce(nullif(trim(j ->> '$.label'), ''), 'N/A') AS label, coalesce(nullif(trim(j ->> '$.Yes'), ''), '0') AS yes FROM p WHERE json_type(j) = 'OBJECT'""")
def label_schema(spark, sf_dir):
    """Missing keys of stored label probabilities, and defaults in their place."""
    m = F.from_json("agent4_label_probs", "map<string,string>")
    d = table(spark, sf_dir, PAIRS).select("pair_id", m.alias("m")).where("m is not null")
    full = parsing.fill(F.col("m"), {"label": "N/A", "Yes": "0", "No": "0"})
    issues = F.array_join(parsing.schema_issues(F.map_filter("m", lambda k, v: v.isNotNull()), ["Yes", "No", "label"], {}), ";")
    return d.select("pair_id", issues.alias("issues"), full["label"].alias("label"), full["Yes"].alias("yes"))


@query("""
SELECT count(*) AS claims, count(*) FILTER (total_refinement_rounds = 5) AS five_rounds, count(*) FILTER (reached_max_refinement_bound) AS bound, count(*) FILTER (human_review_oscillation) AS flagged,
  count(*) FILTER (len(from_json(label_history, '["VARCHAR"]')) = 6) AS six_labels FROM verge_final_pair_level WHERE exit_reason = 'MAX_ROUNDS_LABEL_OSCILLATION'""")
def oscillation_audit(spark, sf_dir):
    """The oscillating claims and the four invariants each must keep."""
    p = table(spark, sf_dir, PAIRS).where("exit_reason = 'MAX_ROUNDS_LABEL_OSCILLATION'")
    six = F.size(F.from_json("label_history", "array<string>")) == 6
    return p.agg(F.count("*").alias("claims"), F.count_if(F.col("total_refinement_rounds") == 5).alias("five_rounds"), F.count_if("reached_max_refinement_bound").alias("bound"), F.count_if("human_review_oscillation").alias("flagged"), F.count_if(six).alias("six_labels"))


@query(f"SELECT claim_id, coalesce(NOTE_ID, CAST(_run_row_index AS VARCHAR)) AS row_id, lower(trim(regexp_replace(replace(feature, '_', ' '), '\\s+', ' ', 'g'))) AS feature FROM agent2_claims_pair_level WHERE {_label('prediction')} IS NULL")
def missing_labels(spark, sf_dir):
    """Claims without a label, named by their note or, where that is null, by their row."""
    c = table(spark, sf_dir, CLAIMS).where(N.label(F.col("prediction")).isNull())
    return c.select("claim_id", F.coalesce("NOTE_ID", F.col("_run_row_index").cast("string")).alias("row_id"), N.norm_feature(F.col("feature")).alias("feature"))


@query("""
SELECT pair_id, CASE WHEN agent5_final_label IN ('Yes', 'No') THEN agent5_final_label WHEN final_loop_prediction IN ('Yes', 'No') THEN final_loop_prediction WHEN agent2_prediction IN ('Yes', 'No') THEN agent2_prediction ELSE 'No' END AS label,
  CASE WHEN total_refinement_rounds > 0 THEN 'refiner' WHEN initial_agent3_verdict IS NOT NULL THEN 'verifier' ELSE 'extractor' END AS source, upper(coalesce(nullif(agent5_confidence, ''), 'low')) AS confidence,
  lower(trim(coalesce(for_human_review, ''))) IN ('true', '1', 'yes', 'y') OR coalesce(operational_failure, false) OR coalesce(human_review_oscillation, false) AS review FROM verge_final_pair_level""")
def judge_rows(spark, sf_dir):
    """The judge's label or what stands for it, where it comes from, and whether it goes to review."""
    from functools import reduce

    cols = ("agent5_final_label", "final_loop_prediction", "agent2_prediction")
    label = reduce(lambda acc, c: acc.when(F.col(c).isin("Yes", "No"), F.col(c)), cols[1:], F.when(F.col(cols[0]).isin("Yes", "No"), F.col(cols[0]))).otherwise("No")
    source = F.when(F.col("total_refinement_rounds") > 0, "refiner").when(F.col("initial_agent3_verdict").isNotNull(), "verifier").otherwise("extractor")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    conf = F.upper(F.coalesce(F.when(F.col("agent5_confidence") != "", F.col("agent5_confidence")), F.lit("low")))
    return table(spark, sf_dir, PAIRS).select("pair_id", label.alias("label"), source.alias("source"), conf.alias("confidence"), (N.safe_bool(F.col("for_human_review")) | flag("operational_failure") | flag("human_review_oscillation")).alias("review"))


@query("""SELECT pair_id, '{"bleu":' || CASE WHEN final_bleu IS NULL OR isnan(final_bleu) THEN 'null' ELSE '1' END || ',"rounds":' || total_refinement_rounds || '}' AS json FROM verge_final_pair_level""")
def json_safe(spark, sf_dir):
    """A row as JSON, not-a-number as null."""
    bleu = F.when(F.col("final_bleu").isNotNull() & ~F.isnan("final_bleu"), 1)
    return table(spark, sf_dir, PAIRS).select("pair_id", F.to_json(F.struct(bleu.alias("bleu"), F.col("total_refinement_rounds").alias("rounds")), {"ignoreNullFields": "false"}).alias("json"))


# --- sources and sinks (S3, S4, S4b, S6, S8, K1-K4, K6, K7) ---------------------------------------------------------


def _place(spark, name: str) -> str:
    """A folder of this run in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/queries-{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_name, '') AS c_name, coalesce(c_mktsegment, '') AS segment FROM customer")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read again, all as text."""
    at = _place(spark, "csv")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", F.col("c_mktsegment").alias("segment"))
    c.write.option("header", True).option("quote", '"').option("escape", '"').csv(at)
    return io.text_csv(spark, at, Ty.StructType([Ty.StructField(n, Ty.StringType()) for n in c.columns]))


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey % 3 = 0 THEN 'raw' WHEN n_regionkey % 3 = 1 THEN 'valid' ELSE 'failed' END AS status FROM nation")
def status_sink(spark, sf_dir):
    """K1: rows in one folder for each status, read again."""
    at = _place(spark, "status")
    status = F.when(F.col("n_regionkey") % 3 == 0, "raw").when(F.col("n_regionkey") % 3 == 1, "valid").otherwise("failed")
    io.write_by_status(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", status.alias("status")), at)
    return spark.read.parquet(at).select("n_nationkey", "n_name", F.col("status").cast("string").alias("status"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def json_append(spark, sf_dir):
    """K2: rows appended as JSON lines in two goes."""
    at = _place(spark, "json")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    io.append_json(n.drop("n_regionkey"), at)
    io.append_json(n.where("n_regionkey = 1").drop("n_regionkey"), at)
    return spark.read.schema("n_nationkey bigint, n_name string").json(at)


@query("SELECT n_nationkey FROM nation WHERE n_regionkey <> 2")
def resumed(spark, sf_dir):
    """What a run that was stopped still has to do."""
    at = _place(spark, "resume")
    n = table(spark, sf_dir, "nation")
    n.where("n_regionkey = 2").select("n_nationkey").write.parquet(at)
    return io.resume(n.select("n_nationkey"), at, ["n_nationkey"])


@query("SELECT sha256('one line' || chr(10)) AS sha256, CAST(9 AS BIGINT) AS length")
def file_manifest(spark, sf_dir):
    """K4: length and digest of the files of a folder."""
    at = _place(spark, "manifest")
    spark.createDataFrame([("one line",)], "value string").coalesce(1).write.text(at)
    return io.manifest(spark, at).where("path like '%part-%'").select("sha256", "length")


@query("WITH lex(feature, alias, ord) AS (VALUES " + _LEX + ") SELECT feature, lower(alias) AS term FROM lex")
def synonym_file(spark, sf_dir):
    """S3: a JSON dictionary of lists, in capitals, read as terms in lower case."""
    import json

    at = _place(spark, "synonyms")
    text = json.dumps({f: [a.upper() for a in dict.fromkeys(terms)] for f, terms in V.ALIASES.items()})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    return io.synonyms(spark, at)


@query("WITH lex(term, name, ord) AS (VALUES " + ", ".join(f"('{t}', '{c}', 0)" for c, ts in V.RETRIEVAL_TERMS.items() for t in ts) + ") SELECT term, name, length(term) > 12 AS group_a FROM lex")
def concept_file(spark, sf_dir):
    """A concept dictionary, split in two groups; where the file is missing the curated terms stand for it."""
    import json

    at = _place(spark, "concepts")
    text = json.dumps({t.upper(): {"name": c, "is_group_a": len(t) > 12} for c, ts in V.RETRIEVAL_TERMS.items() for t in ts})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    return io.concepts_or(spark, at, V.RETRIEVAL_TERMS)


@query("SELECT CAST(25 AS BIGINT) AS rows, 'n_nationkey,n_name' AS columns")
def chosen_file(spark, sf_dir):
    """Of two files the one with the columns wanted and the right number of rows."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name")
    paths = [_place(spark, "few"), _place(spark, "all")]
    for p, d in zip(paths, (n.limit(3), n)):
        d.coalesce(1).write.option("header", True).csv(p)
    at = io.pick_by_invariant(spark, paths, ["N_NATIONKEY", "n_name"], lambda d: d.count() == 25)
    d = io.text_csv(spark, at)
    return d.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(",".join(d.columns)))


_TAGGED = f"""WITH {mentions_sql(_SRC)}, g AS (SELECT r, t, list_sort(list({{'s': s, 'e': e, 'a': alias}})) AS k FROM m WHERE feature = 'Diarrhea' GROUP BY r, t)"""


def _marked_notes(spark, sf_dir) -> DataFrame:
    m = T.mentions(spread(table(spark, sf_dir, NOTES)), "_run_row_index", "Clean_note_text", {"Diarrhea": V.ALIASES["Diarrhea"]})
    g = m.groupBy("_run_row_index").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.lit("DIARRHEA").alias("tag")))).alias("s"))
    return table(spark, sf_dir, NOTES).select("_run_row_index", F.translate(F.lower("Clean_note_text"), "\x01\x02", "  ").alias("t")).join(g, "_run_row_index")


@query(_TAGGED + " SELECT r AS _run_row_index, md5(array_to_string(list_transform(range(1, len(k) + 1), lambda i: substr(t, CASE WHEN i = 1 THEN 1 ELSE k[i - 1].e + 1 END, k[i].s - CASE WHEN i = 1 THEN 0 ELSE k[i - 1].e END) || '[[' || substr(t, k[i].s + 1, k[i].e - k[i].s) || '|DIARRHEA]]'), '') || substr(t, k[-1].e + 1)) AS tagged FROM g")
def tagged_notes(spark, sf_dir):
    """K7: notes with one finding's mentions tagged."""
    return _marked_notes(spark, sf_dir).select("_run_row_index", F.md5(io.tagged(F.col("t"), F.col("s"))).alias("tagged"))


@query(_TAGGED + " SELECT r AS _run_row_index, CAST(len(k) AS INTEGER) AS marks FROM g")
def html_notes(spark, sf_dir):
    """K6: the same as HTML; the marks are counted, as markup in the text is escaped."""
    return _marked_notes(spark, sf_dir).select("_run_row_index", F.regexp_count(io.html(F.col("t"), F.col("s")), F.lit('<mark class="DIARRHEA">')).alias("marks"))


# --- more rules over mentions (P6, P9, M11, M14, M20) -------------------------------------------------------------

_Q = "trim(regexp_replace({b}, '(?s)^.*[\\n.;]', '') || substr(t, s + 1, e - s) || regexp_extract({a}, '(?s)^[^\\n.;]*[\\n.;]?'), ' ')"
_Q100, _Q140 = (_Q.format(b=_BEFORE.format(n=n), a=_AFTER.format(n=n)) for n in (100, 140))
_ELIGIBLE = f"{_CLASS} IN ('AFFIRMED', 'HISTORICAL') AND (feature <> '{V.FAMILY}' OR (regexp_matches({_Q140}, '{_any(V.RELATIONS)}') AND regexp_matches({_Q140}, '{_any(V.CANCERS)}')))"


@query(f"WITH {mentions_sql(_SRC)} SELECT r AS _run_row_index, feature, s AS start, {_Q100} AS quote FROM m")
def context_quotes(spark, sf_dir):
    """Each mention with its surroundings to the line end, full stop or semicolon."""
    m = T.mentions(spread(table(spark, sf_dir, NOTES)), "_run_row_index", "Clean_note_text", V.ALIASES, 100, 100)
    return m.select("_run_row_index", "feature", "start", S.quote_in(F.col("before"), F.col("alias"), F.col("after")).alias("quote"))


@query(f"""
WITH {mentions_sql(_SRC)}, q AS (SELECT r, feature, alias, s, {_Q100} AS quote FROM m WHERE {_ELIGIBLE}),
o AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY r, feature, {_fold('quote')} ORDER BY s) = 1)
SELECT r AS _run_row_index, feature, alias, s AS start, CAST(row_number() OVER (PARTITION BY r, feature ORDER BY s) AS INTEGER) AS ord FROM o QUALIFY row_number() OVER (PARTITION BY r, feature ORDER BY s) <= 3""")
def direct_candidates(spark, sf_dir):
    """The first three eligible mentions of a finding in a note, one for each wording of their surroundings."""
    return recovery.candidates(spread(table(spark, sf_dir, NOTES)), "_run_row_index", "Clean_note_text", V.ALIASES).select("_run_row_index", "feature", "alias", "start", "ord")


@query(f"""
WITH {mentions_sql(_QSRC)}, a AS (SELECT DISTINCT r, feature FROM m WHERE {_CLASS} IN ('AFFIRMED', 'HISTORICAL')),
c AS (SELECT claim_id, feature, evidence_quote AS q, length({_strip("coalesce(evidence_quote, '')")}) > 5 AND coalesce(contains({_fold('n.Clean_note_text')}, {_fold('evidence_quote')}), false) AS g FROM agent2_claims_pair_level LEFT JOIN rebuilt_notes_by_noteid n USING (_run_row_index) WHERE {_label('prediction')} = 'Yes')
SELECT claim_id, CASE WHEN NOT g THEN 'EVIDENCE_NOT_GROUNDED' ELSE array_to_string(list_filter([CASE WHEN c.feature <> '{V.FAMILY}' AND a.r IS NULL THEN 'NO_ELIGIBLE_AFFIRMATIVE_TARGET_MENTION' END,
  CASE WHEN c.feature = '{V.FAMILY}' AND NOT regexp_matches(q, '{_any(V.RELATIONS)}') THEN 'FAMILY_RELATION_NOT_EXPLICIT' END, CASE WHEN c.feature = '{V.FAMILY}' AND NOT regexp_matches(q, '{_any(V.CANCERS)}') THEN 'CRC_TYPE_NOT_EXPLICIT' END], lambda x: x IS NOT NULL), ';') END AS failures
FROM c LEFT JOIN a ON a.r = claim_id AND a.feature = c.feature""")
def evidence_failures(spark, sf_dir):
    """P9, H13 over positive claims."""
    from .rule_queries import _grounded

    m = T.mentions(table(spark, sf_dir, CLAIMS), "claim_id", "evidence_quote", V.ALIASES, 140, 100)
    ok = m.where(P.assertion_in(F.col("before"), F.col("alias"), F.col("after")).isin("AFFIRMED", "HISTORICAL")).select("claim_id", "feature", F.lit(True).alias("ok")).distinct()
    g = _grounded(spark, sf_dir).where(N.label(F.col("prediction")) == "Yes").join(ok, ["claim_id", "feature"], "left")
    codes = P.evidence_failures(F.col("feature"), F.col("grounded"), F.coalesce("ok", F.lit(False)), F.col("evidence_quote"))
    return g.select("claim_id", F.array_join(codes, ";").alias("failures"))


@query(f"""
WITH {mentions_sql(_SRC)}, k AS (SELECT r, feature, s, {_CLASS} AS c, {_Q100} AS q FROM m)
SELECT r AS _run_row_index, feature, count(*) AS entities, count(*) FILTER (c = 'NEGATED') AS negated, count(*) FILTER (c IN ('HYPOTHETICAL', 'PLANNED')) AS uncertain, count(*) FILTER (c = 'HISTORICAL') AS historical, count(*) FILTER (c = 'AFFIRMED') > 0 AS positive,
  array_to_string(list_transform(list_sort(list({{'s': s, 'q': q}}) FILTER (c = 'AFFIRMED'))[1:5], lambda x: x.q), '|') AS evidence FROM k GROUP BY r, feature""")
def context_entities(spark, sf_dir):
    """M14 by the rules of P3 to P5: the entities of a finding in a note by context, positive if any is clean, with the
    first five of those as evidence. The library of the original is not bit-identical to these rules."""
    m = T.mentions(spread(table(spark, sf_dir, NOTES)), "_run_row_index", "Clean_note_text", V.ALIASES, 140, 100)
    k = m.select("_run_row_index", "feature", "start", P.assertion_in(F.col("before"), F.col("alias"), F.col("after")).alias("c"), S.quote_in(F.col("before"), F.col("alias"), F.col("after")).alias("q"))
    n = lambda *cs: F.count_if(F.col("c").isin(*cs))
    g = k.groupBy("_run_row_index", "feature").agg(
        F.count("*").alias("entities"), n("NEGATED").alias("negated"), n("HYPOTHETICAL", "PLANNED").alias("uncertain"), n("HISTORICAL").alias("historical"), n("AFFIRMED").alias("affirmed"),
        F.array_sort(F.collect_list(F.when(F.col("c") == "AFFIRMED", F.struct("start", "q")))).alias("e"),
    )
    evidence = F.when(F.col("affirmed") > 0, F.array_join(F.transform(F.slice("e", 1, 5), lambda x: x["q"]), "|"))
    return g.select("_run_row_index", "feature", "entities", "negated", "uncertain", "historical", (F.col("affirmed") > 0).alias("positive"), evidence.alias("evidence"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{t}'" for t, ps in V.TIERS for p in ps) + " ELSE 'UNCLASSIFIED' END AS tier, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN regexp_extract(lower(text), '{p}')" for _, ps in V.TIERS for p in ps) + " END AS marker FROM documents WHERE text IS NOT NULL")
def study_tiers(spark, sf_dir):
    """M20 by the fixed lists."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", P.study_tier(F.col("text")).alias("s")).select("doc_id", "s.tier", "s.marker")


@query(f"WITH {_GRADED} SELECT feature, chunk_idx FROM k WHERE coalesce(certainty >= 3, false)")
def filtered_evidence(spark, sf_dir):
    """E4 under a filter: passages of moderate certainty at least."""
    cm, st, profiles = evidence_tables(spark, sf_dir)
    bodies = retrieval.resolve_chunks(cm, st).join(profiles.select("body_id", "score"), "body_id")
    return retrieval.annotate(passages(spark, sf_dir), bodies, filter_below=3).where("eligible").select("feature", "chunk_idx")


# --- grounding and retries (G8, G10, G11, X9, V14) ----------------------------------------------------------------


@query()
def window_levels(spark, sf_dir):
    """The four-level cascade over all quotations."""
    from .score_queries import quotes

    return T.window_grounding(quotes(spark, sf_dir), "claim_id", "Clean_note_text", "evidence_quote").select("claim_id", "level", F.round("score", 6).alias("score"))


_ORD = "list_position([" + ", ".join(f"'{f}'" for f in V.FINDINGS) + "], feature)"


@query(f"""
SELECT pair_id, CAST(turn AS INTEGER) AS turn FROM (SELECT pair_id, row_number() OVER (PARTITION BY _run_row_index ORDER BY {_ORD}, pair_id) AS turn FROM verge_final_pair_level
  WHERE final_loop_prediction = 'Yes' AND coalesce(CASE WHEN isnan(final_bleu) THEN NULL ELSE final_bleu END, 0) < 0.15) WHERE turn <= 4""")
def grounding_retries(spark, sf_dir):
    """Positives that go to another retrieval, at most four a note in the findings' order."""
    p = table(spark, sf_dir, PAIRS).withColumn("b", F.when(~F.isnan("final_bleu"), F.col("final_bleu"))).withColumn("o", F.array_position(F.array(*map(F.lit, V.FINDINGS)), F.col("feature")))
    return T.retries(p, "_run_row_index", "final_loop_prediction", "b", F.struct("o", "pair_id")).select("pair_id", "turn")


@query(f"""
WITH {_GOLD}, y AS (SELECT feature, gold = 'Yes' AS right_, CASE WHEN isnan(bleu) THEN NULL ELSE bleu END AS b FROM scored WHERE after = 'Yes')
SELECT CASE WHEN GROUPING(feature) = 1 THEN 'ALL' ELSE feature END AS scope, count(*) FILTER (right_) AS tp, count(*) FILTER (NOT right_) AS fp, round(avg(b) FILTER (right_), 6) AS bleu_tp, round(avg(b) FILTER (NOT right_), 6) AS bleu_fp,
  round(avg(b) FILTER (right_) - avg(b) FILTER (NOT right_), 6) AS gap, avg(b) FILTER (right_) - avg(b) FILTER (NOT right_) < 0.1 AS low_gap FROM y GROUP BY ROLLUP (feature)""")
def grounding_by_correctness(spark, sf_dir):
    """Grounding of right and wrong positives, by finding and all, and whether the gap is low."""
    y = scored_pairs(spark, sf_dir).where("after = 'Yes'").select("feature", (F.col("gold") == "Yes").alias("r"), F.when(~F.isnan("bleu"), F.col("bleu")).alias("b"))
    tp, fp = F.avg(F.when(F.col("r"), F.col("b"))), F.avg(F.when(~F.col("r"), F.col("b")))
    aggs = [F.count_if("r").alias("tp"), F.count_if(~F.col("r")).alias("fp"), F.round(tp, 6).alias("bleu_tp"), F.round(fp, 6).alias("bleu_fp"), F.round(tp - fp, 6).alias("gap"), (tp - fp < 0.1).alias("low_gap")]
    return stats.by_scope(y, "feature", aggs).withColumnRenamed("feature", "scope")


@query("""
WITH p AS (SELECT pair_id, agent2_prediction AS a, final_loop_prediction AS b, CASE WHEN isnan(final_rouge_l) THEN NULL ELSE final_rouge_l END AS x, CASE WHEN isnan(final_bleu) THEN NULL ELSE final_bleu END AS y, label_stable AS s, total_refinement_rounds AS n FROM verge_final_pair_level)
SELECT pair_id, a IS NOT DISTINCT FROM b AND CASE WHEN n > 1 THEN coalesce(s, false) ELSE coalesce(y, 0) >= 0.1 OR coalesce(y, 0) > coalesce(x, 0) END AS accepted,
  CASE WHEN coalesce(y, -1) > greatest(coalesce(x, -1), -1) THEN b WHEN coalesce(x, -1) > -1 THEN a END AS adopted FROM p""")
def retry_acceptance(spark, sf_dir):
    """Retries that are taken - no issue left, or grounding that is enough or better, and never another label - and
    the label of the attempt with the best grounding. Two stored scores stand for the two attempts."""
    from ..operators.claims import accept_retry

    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    p = table(spark, sf_dir, PAIRS).withColumns({"x": clean("final_rouge_l"), "y": clean("final_bleu")})
    none = F.array().cast("array<string>")
    before, after = F.when(F.col("total_refinement_rounds") > 1, F.array(F.lit("i"))).otherwise(none), F.when(F.coalesce("label_stable", F.lit(False)), none).otherwise(F.array(F.lit("i")))
    taken = accept_retry(before, after, F.col("x"), F.col("y"), F.col("agent2_prediction"), F.col("final_loop_prediction"))
    attempt = lambda label, score: F.struct(F.col(label).alias("label"), F.coalesce(F.col(score), F.lit(-1.0)).alias("score"))
    best = loop.adopt_best(F.array(attempt("agent2_prediction", "x"), attempt("final_loop_prediction", "y")))
    return p.select("pair_id", taken.alias("accepted"), best["label"].alias("adopted"))


# --- contracts (S2, H3, H4, H7, H9, J12) --------------------------------------------------------------------------


@query(f"SELECT chunk_idx, text FROM {_CHUNK}")
def loaded_chunks(spark, sf_dir):
    """S2, strict: an empty chunk would be an error."""
    return parsing.load_chunks(table(spark, sf_dir, "pubmed_chunks_sentences")).select("chunk_idx", "text")


@query("""
SELECT claim_id, array_to_string(list_filter([CASE WHEN trim(coalesce(evidence_quote, '')) = '' THEN 'BLANK:evidence_quote' END, CASE WHEN trim(coalesce(NOTE_ID, '')) = '' THEN 'BLANK:NOTE_ID' END, CASE WHEN confidence IS NULL OR confidence < 0 THEN 'NO_WHOLE_NUMBER:confidence' END], lambda x: x IS NOT NULL), ';') AS violations
FROM agent2_claims_pair_level WHERE trim(coalesce(evidence_quote, '')) = '' OR trim(coalesce(NOTE_ID, '')) = '' OR confidence IS NULL OR confidence < 0""")
def cell_contracts(spark, sf_dir):
    """H3, H4: cells that break the contract, in columns found by their names whatever the case."""
    from ..operators.contracts import find_column

    c = table(spark, sf_dir, CLAIMS)
    names = [find_column(c, [n]) for n in ("EVIDENCE_QUOTE", "note_id", "Confidence")]
    return io.contract_violations(c, "claim_id", names[:2], names[2:]).select("claim_id", F.array_join("violations", ";").alias("violations"))


@query("""
SELECT p.pair_id FROM verge_final_pair_level p JOIN rebuilt_notes_by_noteid n USING (_run_row_index) WHERE p.PAT_ID IS DISTINCT FROM n.PAT_ID OR p.NOTE_ID IS DISTINCT FROM n.NOTE_ID""")
def identity_conflicts(spark, sf_dir):
    """Results whose patient or note is spelled otherwise than in the note itself."""
    n = table(spark, sf_dir, NOTES).select("_run_row_index", F.col("PAT_ID").alias("PAT_ID_n"), F.col("NOTE_ID").alias("NOTE_ID_n"))
    j = table(spark, sf_dir, PAIRS).join(n, "_run_row_index")
    return j.where(~F.col("PAT_ID").eqNullSafe(F.col("PAT_ID_n")) | ~F.col("NOTE_ID").eqNullSafe(F.col("NOTE_ID_n"))).select("pair_id")


@query("SELECT n_nationkey, n_name FROM nation")
def cached_table(spark, sf_dir):
    """H7: a table that is built once and then read."""
    at = _place(spark, "cache")
    build = lambda: table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    io.build_or_load(spark, at, build)
    return io.build_or_load(spark, at, lambda: spark.range(0).selectExpr("id n_nationkey", "'' n_name"))


@query("SELECT claim_id, 'Finding: ' || feature || chr(10) || 'Label: ' || coalesce(prediction, '') || chr(10) || 'Quote: ' || coalesce(evidence_quote, '') AS prompt FROM agent2_claims_pair_level")
def prompts(spark, sf_dir):
    """H9: a template filled from a claim; the wording is the caller's."""
    p = recovery.prompt("Finding: {f}\nLabel: {l}\nQuote: {q}", f=F.col("feature"), l=F.col("prediction"), q=F.col("evidence_quote"))
    return table(spark, sf_dir, CLAIMS).select("claim_id", p.alias("prompt"))
