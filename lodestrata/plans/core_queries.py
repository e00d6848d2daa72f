"""Queries of the relational, text, loop and evaluation operators, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import normalize as N
from ..functions import policy as P
from ..functions import vocabulary as V
from ..operators import contracts, loop
from ..operators import text as T
from ..session import spread
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOTES, CLAIMS, PAIRS, GOLD = "rebuilt_notes_by_noteid", "agent2_claims_pair_level", "verge_final_pair_level", "gold_pairs"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- profile (A1-A13) --------------------------------------------------------------------------------------------


@query("""
SELECT count(*) AS notes, count(DISTINCT PAT_ID) AS patients, count(*) FILTER (Clean_note_text IS NULL OR regexp_replace(Clean_note_text, '[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g') = '') AS empty,
  count(*) FILTER (length(Clean_note_text) < 50) AS short, count(*) FILTER (length(Clean_note_text) >= 50) AS usable,
  CAST(floor(avg(length(Clean_note_text))) AS BIGINT) AS mean_length, CAST(max(length(Clean_note_text)) AS BIGINT) AS max_length, CAST(min(length(Clean_note_text)) AS BIGINT) AS min_length
FROM rebuilt_notes_by_noteid""")
def note_profile(spark, sf_dir):
    """A1."""
    n = F.length("Clean_note_text")
    return table(spark, sf_dir, NOTES).agg(
        F.count("*").alias("notes"), F.count_distinct("PAT_ID").alias("patients"), F.count_if(~F.coalesce(F.col("Clean_note_text").rlike(r"(?U)\S"), F.lit(False))).alias("empty"),
        F.count_if(n < 50).alias("short"), F.count_if(n >= 50).alias("usable"), F.floor(F.avg(n)).alias("mean_length"), F.max(n).cast("bigint").alias("max_length"),
        F.min(n).cast("bigint").alias("min_length"),
    )


@query("""
WITH g AS (SELECT PAT_ID, count(*) AS n FROM rebuilt_notes_by_noteid WHERE PAT_ID IS NOT NULL GROUP BY PAT_ID)
SELECT min(n) AS least, CAST(median(n) AS DOUBLE) AS median, max(n) AS most, round(avg(n), 6) AS mean FROM g""")
def notes_per_patient(spark, sf_dir):
    """A2."""
    g = table(spark, sf_dir, NOTES).where("PAT_ID is not null").groupBy("PAT_ID").agg(F.count("*").alias("n"))
    return g.agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("""
SELECT CASE WHEN n < 100 THEN 'a' WHEN n < 500 THEN 'b' WHEN n < 2000 THEN 'c' WHEN n < 5000 THEN 'd' WHEN n < 12000 THEN 'e' ELSE 'f' END AS bin, count(*) AS notes
FROM (SELECT length(Clean_note_text) AS n FROM rebuilt_notes_by_noteid WHERE Clean_note_text IS NOT NULL) GROUP BY 1""")
def length_histogram(spark, sf_dir):
    """A3: six half-open bins."""
    n = F.length("Clean_note_text")
    bin_ = F.when(n < 100, "a").when(n < 500, "b").when(n < 2000, "c").when(n < 5000, "d").when(n < 12000, "e").otherwise("f")
    return table(spark, sf_dir, NOTES).where("Clean_note_text is not null").groupBy(bin_.alias("bin")).agg(F.count("*").alias("notes"))


@query("""
SELECT count(*) FILTER (PAT_ID IS NULL) AS no_patient, count(*) FILTER (CONTACT_DATE IS NULL) AS no_date, CAST(min(CONTACT_DATE) AS VARCHAR) AS first_date,
  CAST(max(CONTACT_DATE) AS VARCHAR) AS last_date, (SELECT _run_row_index FROM rebuilt_notes_by_noteid WHERE Clean_note_text IS NOT NULL ORDER BY length(Clean_note_text) DESC, _run_row_index LIMIT 1) AS longest
FROM rebuilt_notes_by_noteid""")
def nulls_and_range(spark, sf_dir):
    """A4: the longest note is the first of the longest."""
    n = F.struct(F.length("Clean_note_text"), -F.col("_run_row_index"))
    return table(spark, sf_dir, NOTES).agg(
        F.count_if(F.col("PAT_ID").isNull()).alias("no_patient"), F.count_if(F.col("CONTACT_DATE").isNull()).alias("no_date"), F.min("CONTACT_DATE").cast("string").alias("first_date"),
        F.max("CONTACT_DATE").cast("string").alias("last_date"), F.max_by("_run_row_index", n).alias("longest"),
    )


_LABEL = "CASE WHEN lower(trim({0})) IN ('yes','1','true','present','y') THEN 'Yes' WHEN lower(trim({0})) IN ('no','0','false','absent','n','not mentioned','not mentioned outside ros') THEN 'No' END"


@query(f"""
SELECT feature, count(*) FILTER (l = 'Yes') AS yes, count(*) FILTER (l = 'No') AS no, count(*) FILTER (l IS NULL) AS other, round(count(*) FILTER (l = 'Yes') / count(*), 6) AS rate
FROM (SELECT feature, {_LABEL.format('prediction')} AS l FROM agent2_claims_pair_level) GROUP BY feature""")
def label_rates(spark, sf_dir):
    """A5, N3."""
    c = table(spark, sf_dir, CLAIMS).select("feature", N.label(F.col("prediction")).alias("l"))
    yes = F.count_if(F.col("l") == "Yes")
    return c.groupBy("feature").agg(yes.alias("yes"), F.count_if(F.col("l") == "No").alias("no"), F.count_if(F.col("l").isNull()).alias("other"), F.round(yes / F.count("*"), 6).alias("rate"))


@query(f"""
SELECT feature, round(avg(confidence) FILTER (l = 'Yes'), 6) AS mean_yes, round(avg(confidence) FILTER (l = 'No'), 6) AS mean_no,
  round(stddev_samp(confidence) FILTER (l = 'Yes'), 6) AS sd_yes, round(stddev_samp(confidence) FILTER (l = 'No'), 6) AS sd_no,
  round(avg(confidence) FILTER (l = 'Yes') - avg(confidence) FILTER (l = 'No'), 6) AS gap
FROM (SELECT feature, CAST(confidence AS DOUBLE) AS confidence, {_LABEL.format('prediction')} AS l FROM agent2_claims_pair_level) GROUP BY feature""")
def confidence_by_label(spark, sf_dir):
    """Mean and sample deviation by label."""
    c = table(spark, sf_dir, CLAIMS).select("feature", F.col("confidence").cast("double").alias("c"), N.label(F.col("prediction")).alias("l"))
    of = lambda f, v: f(F.when(F.col("l") == v, F.col("c")))
    return c.groupBy("feature").agg(
        F.round(of(F.avg, "Yes"), 6).alias("mean_yes"), F.round(of(F.avg, "No"), 6).alias("mean_no"), F.round(of(F.stddev_samp, "Yes"), 6).alias("sd_yes"),
        F.round(of(F.stddev_samp, "No"), 6).alias("sd_no"), F.round(of(F.avg, "Yes") - of(F.avg, "No"), 6).alias("gap"),
    )


@query("""
SELECT term, n FROM (SELECT unnest(regexp_extract_all(lower(Clean_note_text), '[a-z]{3,}')) AS term, 1 AS one FROM rebuilt_notes_by_noteid) t
JOIN (SELECT u AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(Clean_note_text), '[a-z]{3,}')) AS u FROM rebuilt_notes_by_noteid) GROUP BY u) c USING (term)
GROUP BY term, n ORDER BY n DESC, term LIMIT 25""")
def top_terms(spark, sf_dir):
    """A top-k report."""
    w = table(spark, sf_dir, NOTES).select(F.explode(F.regexp_extract_all(F.lower("Clean_note_text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(25)


@query("""
SELECT exit_reason, feature, count(*) AS claims, CAST(sum(total_refinement_rounds) AS BIGINT) AS rounds FROM verge_final_pair_level
GROUP BY GROUPING SETS ((), (exit_reason), (feature), (exit_reason, feature))""")
def exit_rollup(spark, sf_dir):
    """All roll-ups in one pass."""
    return table(spark, sf_dir, PAIRS).cube("exit_reason", "feature").agg(F.count("*").alias("claims"), F.sum("total_refinement_rounds").alias("rounds"))


@query("""
SELECT _run_row_index, count(*) AS claims, count(*) FILTER (final_loop_prediction = 'Yes') AS yes, count(*) FILTER (final_loop_prediction = 'No') AS no,
  CAST(sum(total_refinement_rounds) AS BIGINT) AS rounds, CAST(sum(flip_count) AS BIGINT) AS flips, count(*) FILTER (human_review_oscillation) AS review
FROM verge_final_pair_level GROUP BY _run_row_index""")
def note_rollup(spark, sf_dir):
    """A9."""
    p = F.col("final_loop_prediction")
    return table(spark, sf_dir, PAIRS).groupBy("_run_row_index").agg(
        F.count("*").alias("claims"), F.count_if(p == "Yes").alias("yes"), F.count_if(p == "No").alias("no"), F.sum("total_refinement_rounds").alias("rounds"), F.sum("flip_count").alias("flips"),
        F.count_if("human_review_oscillation").alias("review"),
    )


_NID = "regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\.0$', '')"
_GOLD = f"""
gold AS (SELECT nid, feature, min(g) AS gold FROM (
  SELECT {_NID.format('NOTE_ID')} AS nid, lower(trim(regexp_replace(replace(Symptom, '_', ' '), '\\s+', ' ', 'g'))) AS feature, {_LABEL.format('Gold')} AS g FROM gold_pairs)
  WHERE g IS NOT NULL AND nid <> '' GROUP BY nid, feature HAVING min(g) = max(g)),
pred AS (SELECT {_NID.format('NOTE_ID')} AS nid, lower(feature) AS feature, min_by(agent2_prediction, pair_id) AS before, min_by(final_loop_prediction, pair_id) AS after,
    min_by(final_bleu, pair_id) AS bleu, min_by(exit_reason, pair_id) AS exit_reason, min_by(operational_failure, pair_id) AS failed, min_by(final_rouge_l, pair_id) AS rouge,
    min_by(initial_agent3_verdict, pair_id) AS v0, min_by(final_agent3_verdict, pair_id) AS v1
  FROM verge_final_pair_level WHERE NOTE_ID IS NOT NULL GROUP BY 1, 2),
scored AS (SELECT gold.nid, gold.feature, gold.gold, before, after, bleu, rouge, exit_reason, failed, v0, v1 FROM gold LEFT JOIN pred USING (nid, feature))"""


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreed gold labels, one row a note and finding, with the first stored prediction of the pair."""
    g = table(spark, sf_dir, GOLD).select(N.normalize_id(F.col("NOTE_ID")).alias("nid"), N.norm_feature(F.col("Symptom")).alias("feature"), N.label(F.col("Gold")).alias("gold"))
    gold = contracts.agreed(g.where("nid <> ''"), ["nid", "feature"], "gold")
    cols = {"agent2_prediction": "before", "final_loop_prediction": "after", "final_bleu": "bleu", "exit_reason": "exit_reason", "operational_failure": "failed", "final_rouge_l": "rouge",
            "initial_agent3_verdict": "v0", "final_agent3_verdict": "v1"}
    p = table(spark, sf_dir, PAIRS).where("NOTE_ID is not null").groupBy(N.normalize_id(F.col("NOTE_ID")).alias("nid"), F.lower("feature").alias("feature"))
    return gold.join(p.agg(*(F.min_by(c, "pair_id").alias(a) for c, a in cols.items())), ["nid", "feature"], "left")


@query(f"""
WITH {_GOLD}, q AS (SELECT feature, CASE WHEN before = after THEN 'none' WHEN after = gold AND before <> gold THEN 'corrective' WHEN before = gold AND after <> gold THEN 'degrading' ELSE 'other' END AS q
  FROM scored WHERE before IS NOT NULL)
SELECT feature, count(*) FILTER (q = 'corrective') AS corrective, count(*) FILTER (q = 'degrading') AS degrading, count(*) FILTER (q = 'none') AS none, count(*) FILTER (q = 'other') AS other,
  count(*) FILTER (q = 'corrective') - count(*) FILTER (q = 'degrading') AS net FROM q GROUP BY feature""")
def change_quality(spark, sf_dir):
    """Pivot with absent classes as 0."""
    s = scored_pairs(spark, sf_dir).where("before is not null").select("feature", loop.change_quality(F.col("gold"), F.col("before"), F.col("after")).alias("q"))
    wide = s.groupBy("feature").pivot("q", ["corrective", "degrading", "none", "other"]).count().na.fill(0)
    return wide.withColumn("net", F.col("corrective") - F.col("degrading"))


@query("""
WITH q AS (SELECT len(regexp_extract_all(lower(evidence_quote), '[\\p{L}\\p{N}_]+|[^\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\p{L}\\p{N}_]')) AS n FROM agent2_claims_pair_level WHERE length(evidence_quote) > 5)
SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) AS median, round(quantile_cont(CAST(n AS DOUBLE), 0.95), 6) AS p95, CAST(max(n) AS BIGINT) AS most, count(*) FILTER (n >= 32) AS at_cap FROM q""")
def quote_token_percentiles(spark, sf_dir):
    """Exact percentiles with linear interpolation."""
    q = table(spark, sf_dir, CLAIMS).where(F.length("evidence_quote") > 5).select(F.size(N.tokens(F.col("evidence_quote"))).alias("n"))
    return q.agg(F.percentile("n", 0.5).alias("median"), F.round(F.percentile("n", 0.95), 6).alias("p95"), F.max("n").cast("bigint").alias("most"), F.count_if(F.col("n") >= 32).alias("at_cap"))


@query("""
SELECT _run_row_index, array_to_string(list_sort(list_distinct(list(feature))), ' | ') AS found FROM agent2_claims_pair_level WHERE lower(trim(prediction)) = 'yes' GROUP BY _run_row_index""")
def terms_joined(spark, sf_dir):
    """A12."""
    c = table(spark, sf_dir, CLAIMS).where(N.label(F.col("prediction")) == "Yes")
    return c.groupBy("_run_row_index").agg(F.array_join(F.array_sort(F.collect_set("feature")), " | ").alias("found"))


@query(f"""
SELECT claim_id, last_value(l IGNORE NULLS) OVER (PARTITION BY p, feature ORDER BY claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
FROM (SELECT claim_id, {_NID.format('PAT_ID')} AS p, feature, {_LABEL.format('prediction')} AS l FROM agent2_claims_pair_level)""")
def patient_memory(spark, sf_dir):
    """The latest label of a patient and finding before this claim."""
    c = table(spark, sf_dir, CLAIMS).select("claim_id", N.normalize_id(F.col("PAT_ID")).alias("p"), "feature", N.label(F.col("prediction")).alias("l"))
    return contracts.last_before(c, ["p", "feature"], "claim_id", "l", "known").select("claim_id", "known")


# --- normalisers (N1-N14) ----------------------------------------------------------------------------------------


@query(f"SELECT _run_row_index, {_NID.format('PAT_ID')} AS pat, {_NID.format('NOTE_ID')} AS note FROM rebuilt_notes_by_noteid")
def normalized_ids(spark, sf_dir):
    """N1."""
    return table(spark, sf_dir, NOTES).select("_run_row_index", N.normalize_id(F.col("PAT_ID")).alias("pat"), N.normalize_id(F.col("NOTE_ID")).alias("note"))


@query(f"""
SELECT pair_id, {_LABEL.format('agent2_prediction')} AS label,
  CASE WHEN lower(trim(for_human_review)) IN ('true','1','yes','y') THEN true WHEN lower(trim(for_human_review)) IN ('false','0','no','n') THEN false END AS review,
  coalesce(lower(trim(for_human_review)) IN ('true','1','yes','y'), false) AS review_two FROM verge_final_pair_level""")
def label_normalise(spark, sf_dir):
    """Three-state and two-state booleans of text."""
    r = F.col("for_human_review")
    return table(spark, sf_dir, PAIRS).select("pair_id", N.label(F.col("agent2_prediction")).alias("label"), N.tri_bool(r).alias("review"), N.safe_bool(r).alias("review_two"))


@query("SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS number FROM events")
def extract_number(spark, sf_dir):
    """N5."""
    return table(spark, sf_dir, "events").select("event_id", N.first_number(F.col("props")).alias("number"))


@query("""
SELECT _run_row_index, CASE WHEN length(Clean_note_text) <= 1000 THEN Clean_note_text ELSE left(Clean_note_text, 500) || chr(10) || '...' || chr(10) || right(Clean_note_text, 500) END AS both_ends,
  CASE WHEN length(Clean_note_text) <= 1000 THEN Clean_note_text ELSE left(Clean_note_text, 994) || ' [cut]' END AS beginning FROM rebuilt_notes_by_noteid""")
def truncated(spark, sf_dir):
    """N10, N11."""
    t = F.col("Clean_note_text")
    return table(spark, sf_dir, NOTES).select("_run_row_index", N.truncate_middle(t, 1000).alias("both_ends"), N.truncate_right(t, 1000).alias("beginning"))


@query("""
SELECT pair_id, coalesce(exit_reason IN ('MAX_ROUNDS_LABEL_OSCILLATION','MAX_ROUNDS_FINAL_VERIFICATION_ERROR','REFINEMENT_ERROR'), false) OR coalesce(human_review_oscillation, false)
  OR coalesce(operational_failure, false) OR coalesce(lower(trim(for_human_review)) IN ('true','1','yes','y'), false) AS review FROM verge_final_pair_level""")
def review_flags(spark, sf_dir):
    """N14."""
    flag = loop.review_needed(F.col("exit_reason"), F.col("human_review_oscillation"), F.col("operational_failure"), N.tri_bool(F.col("for_human_review")))
    return table(spark, sf_dir, PAIRS).select("pair_id", flag.alias("review"))


# --- joins (J1-J13) ----------------------------------------------------------------------------------------------

_FIRST = "SELECT _run_row_index, feature, min({0}) AS {0}, count(*) AS n FROM {1} GROUP BY _run_row_index, feature"


@query(f"""
SELECT CASE WHEN a._run_row_index IS NOT NULL AND b._run_row_index IS NOT NULL THEN 'both' WHEN a._run_row_index IS NOT NULL THEN 'left' ELSE 'right' END AS side, count(*) AS pairs,
  CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS claims, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS results
FROM ({_FIRST.format('claim_id', CLAIMS)}) a FULL JOIN ({_FIRST.format('pair_id', PAIRS)}) b ON a._run_row_index = b._run_row_index AND a.feature = b.feature GROUP BY 1""")
def outer_contract(spark, sf_dir):
    """Claims against results, one row a note and finding on either side."""
    keys = ["_run_row_index", "feature"]
    one = lambda name, c: table(spark, sf_dir, name).groupBy(*keys).agg(F.min(c).alias(c), F.count("*").alias("n"))
    j = contracts.full_outer(one(CLAIMS, "claim_id"), one(PAIRS, "pair_id"), keys)
    return j.groupBy("side").agg(F.count("*").alias("pairs"), F.sum(F.coalesce("n_a", F.lit(0))).alias("claims"), F.sum(F.coalesce("n_b", F.lit(0))).alias("results"))


@query("""
SELECT c.claim_id, n.CONTACT_NUM, length(n.Clean_note_text) AS n_chars, contains(n.Clean_note_text, c.evidence_quote) AS quoted
FROM agent2_claims_pair_level c LEFT JOIN rebuilt_notes_by_noteid n USING (_run_row_index) WHERE length(c.evidence_quote) > 5""")
def claims_with_notes(spark, sf_dir):
    """Many claims to one note; the sides choose their own way by size."""
    c = table(spark, sf_dir, CLAIMS).where(F.length("evidence_quote") > 5).select("claim_id", "_run_row_index", "evidence_quote")
    n = table(spark, sf_dir, NOTES).select("_run_row_index", "CONTACT_NUM", "Clean_note_text")
    return c.join(n, "_run_row_index", "left").select("claim_id", "CONTACT_NUM", F.length("Clean_note_text").alias("n_chars"), F.contains("Clean_note_text", "evidence_quote").alias("quoted"))


@query(f"WITH {_GOLD} SELECT nid, feature, gold, before, after FROM scored")
def gold_join(spark, sf_dir):
    """Gold pairs without a prediction stay."""
    return scored_pairs(spark, sf_dir).select("nid", "feature", "gold", "before", "after")


@query(f"""
SELECT nid, feature, count(DISTINCT g) AS values FROM (
  SELECT {_NID.format('NOTE_ID')} AS nid, lower(trim(regexp_replace(replace(Symptom, '_', ' '), '\\s+', ' ', 'g'))) AS feature, {_LABEL.format('Gold')} AS g FROM gold_pairs)
WHERE g IS NOT NULL GROUP BY nid, feature HAVING count(DISTINCT g) > 1""")
def gold_conflicts(spark, sf_dir):
    """J13."""
    g = table(spark, sf_dir, GOLD).select(N.normalize_id(F.col("NOTE_ID")).alias("nid"), N.norm_feature(F.col("Symptom")).alias("feature"), N.label(F.col("Gold")).alias("g"))
    return contracts.conflicts(g, ["nid", "feature"], "g")


@query(f"""
WITH k AS (SELECT DISTINCT {_NID.format('NOTE_ID')} AS nid FROM rebuilt_notes_by_noteid WHERE NOTE_ID IS NOT NULL),
changed AS (SELECT DISTINCT {_NID.format('NOTE_ID')} AS nid FROM verge_final_pair_level WHERE agent2_prediction <> final_loop_prediction),
labelled AS (SELECT DISTINCT {_NID.format('NOTE_ID')} AS nid FROM gold_pairs), review AS (SELECT DISTINCT {_NID.format('NOTE_ID')} AS nid FROM verge_final_pair_level WHERE operational_failure)
SELECT nid, nid IN (SELECT nid FROM changed WHERE nid IS NOT NULL) AS in_changed, nid IN (SELECT nid FROM labelled WHERE nid IS NOT NULL) AS in_labelled, nid IN (SELECT nid FROM review WHERE nid IS NOT NULL) AS in_review
FROM k WHERE nid IN (SELECT nid FROM changed WHERE nid IS NOT NULL UNION SELECT nid FROM labelled WHERE nid IS NOT NULL UNION SELECT nid FROM review WHERE nid IS NOT NULL)""")
def semi_flags(spark, sf_dir):
    """Notes in any of three sets, with a flag for each."""
    ids = lambda df: df.select(N.normalize_id(F.col("NOTE_ID")).alias("nid")).where("nid is not null").distinct()
    p = table(spark, sf_dir, PAIRS)
    sets = {"changed": ids(p.where("agent2_prediction <> final_loop_prediction")), "labelled": ids(table(spark, sf_dir, GOLD)), "review": ids(p.where("operational_failure"))}
    return contracts.member_flags(ids(table(spark, sf_dir, NOTES)), ["nid"], sets)


@query("SELECT _run_row_index FROM rebuilt_notes_by_noteid n WHERE NOT EXISTS (SELECT 1 FROM agent2_claims_pair_level c WHERE c._run_row_index = n._run_row_index)")
def anti_resume(spark, sf_dir):
    """Notes that have no claim yet."""
    return contracts.not_done(table(spark, sf_dir, NOTES), table(spark, sf_dir, CLAIMS), ["_run_row_index"]).select("_run_row_index")


@query("""
SELECT _run_row_index, count(*) AS n, array_to_string(list_sort(list_distinct(list(feature))), ';') AS got FROM agent2_claims_pair_level GROUP BY 1 HAVING count(DISTINCT feature) <> 7""")
def incomplete_notes(spark, sf_dir):
    """Notes without all seven findings."""
    return contracts.incomplete(table(spark, sf_dir, CLAIMS), "_run_row_index", "feature", V.FINDINGS).select("_run_row_index", "n", F.array_join("got", ";").alias("got"))


@query("""
SELECT n_name AS nation, r_name AS region, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def region_rollup(spark, sf_dir):
    """A chain of joins; orders are added up by customer before they are joined."""
    t = lambda n: table(spark, sf_dir, n)
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    j = per.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.sum("n").alias("orders"), F.round(F.sum("s"), 2).alias("total"))


# --- spans and assertion (J10, M1-M21, P1-P10) ----------------------------------------------------------------------

DEMO = {f: V.ALIASES[f] for f in V.FINDINGS}


def _alt(terms) -> str:
    return "|".join(t.replace("/", "\\/").replace("'", "''") for t in sorted(terms, key=lambda t: (-len(t), t)))


@query(
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER (regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])(?:{_alt(a)})(?:$|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])')) AS notes FROM (SELECT lower(Clean_note_text) AS t FROM rebuilt_notes_by_noteid)"
        for f, a in DEMO.items()
    )
)
def notes_by_finding(spark, sf_dir):
    """M1, J10 as one filter per finding: notes that mention it."""
    n = spread(table(spark, sf_dir, NOTES)).select(F.lower("Clean_note_text").alias("t"))
    counts = n.agg(*(F.count_if(F.col("t").rlike(T.alternation(a))).alias(f) for f, a in DEMO.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("notes")) for f in DEMO))).alias("s")).select("s.*")


_LEX = ", ".join(f"('{f}', '{a}')" for f, terms in V.ALIASES.items() for a in terms)


@query(f"""
WITH lex(feature, alias) AS (VALUES {_LEX}), words AS (SELECT DISTINCT feature, unnest(string_split(alias, ' ')) AS word FROM lex)
SELECT word FROM words GROUP BY word HAVING count(DISTINCT feature) = 1""")
def term_ambiguity(spark, sf_dir):
    """Words of the lexicon that only one finding uses."""
    words = T.lexicon(spark, V.ALIASES).select("feature", F.explode(F.split("alias", " ")).alias("word")).distinct()
    return T.unambiguous(words, "word").select("word")


@query("""
SELECT _run_row_index, CAST(len(s) AS INTEGER) AS sentences, CAST(len(list_filter(list_transform(range(1, len(s) + 1, 3), lambda i: array_to_string(list_slice(s, i, i + 3), ' ')), lambda c: length(c) > 50)) AS BIGINT) AS chunks
FROM (SELECT _run_row_index, list_filter(string_split(regexp_replace(Clean_note_text, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: length(x) > 20) AS s
  FROM rebuilt_notes_by_noteid WHERE Clean_note_text IS NOT NULL) WHERE len(s) > 0""")
def sentence_chunks(spark, sf_dir):
    """Chunks of four sentences, one shared."""
    n = table(spark, sf_dir, NOTES)
    sentences = F.size(F.filter(F.split("Clean_note_text", r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.length(s) > 20))
    c = T.sentence_chunks(n, "_run_row_index", "Clean_note_text").groupBy("_run_row_index").agg(F.count("*").alias("chunks"))
    base = n.where("Clean_note_text is not null").select("_run_row_index", sentences.alias("sentences")).where("sentences > 0")
    return base.join(c, "_run_row_index", "left").select("_run_row_index", "sentences", F.coalesce("chunks", F.lit(0)).alias("chunks"))


_TIERS = (("VERY_LOW", r"(?i)\b(?:case report|anecdot\w*)\b"), ("LOW", r"(?i)\b(?:tolerates|works as)\b"), ("HIGH", r"(?i)\b(?:colonoscopy|abdominal CT)\b"), ("MODERATE", r"(?i)\b(?:reviewed|history of)\b"))


@query("SELECT tier, count(*) AS docs FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _TIERS) + " ELSE 'UNCLASSIFIED' END AS tier FROM documents WHERE text IS NOT NULL) GROUP BY tier")
def source_tiers(spark, sf_dir):
    """The first tier whose pattern occurs; the order is a parameter."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(P.source_tier(F.col("text"), _TIERS).alias("tier")).agg(F.count("*").alias("docs"))


@query("""
SELECT kept, count(*) AS docs FROM (SELECT NOT regexp_matches(lower(text), '\\b(?:pregnan|pediatric|veterinary|recall|leaflet|fax)') AS kept FROM documents WHERE text IS NOT NULL) GROUP BY kept""")
def exclusion_filter(spark, sf_dir):
    """M19."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy((~F.lower("text").rlike(r"\b(?:pregnan|pediatric|veterinary|recall|leaflet|fax)")).alias("kept")).agg(F.count("*").alias("docs"))


@query("""
SELECT doc_id, CAST(regexp_matches(text, '(?i)[+\\-]\\s*\\w+.*[+\\-]\\s*\\w+') AS INTEGER) + CAST(regexp_matches(text, '(?i)(?:positive|negative) for:?\\s') AS INTEGER)
  + CAST(regexp_matches(text, '(?i)denies:?\\s+\\w+(?:,\\s*\\w+){2,}') AS INTEGER) + CAST(regexp_matches(text, '[☑☐☒]') AS INTEGER) + CAST(regexp_matches(text, '(?i)\\[x\\]|\\[ \\]') AS INTEGER)
  + CASE WHEN length(text) < 200 AND len(regexp_extract_all(text, '(?i)\\b(?:pain|bleeding|nausea|vomiting|diarrhea|constipation|fever|chills|fatigue|headache|cough|sob|dyspnea)\\b')) >= 5 THEN 1 ELSE 0 END AS score
FROM documents WHERE text IS NOT NULL""")
def template_scores(spark, sf_dir):
    """M21."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", P.template_score(F.col("text")).alias("score"))


@query(
    f"SELECT claim_id, regexp_matches(q, '(?i)\\b(?:{'|'.join(V.RELATIONS)})\\b') AS relation, regexp_matches(q, '(?i)\\b(?:{'|'.join(V.CANCERS)})\\b') AS cancer "
    f"FROM (SELECT claim_id, evidence_quote AS q FROM agent2_claims_pair_level WHERE feature = '{V.FAMILY}')"
)
def family_rules(spark, sf_dir):
    """P8."""
    c = table(spark, sf_dir, CLAIMS).where(F.col("feature") == V.FAMILY)
    return c.select("claim_id", P.has_relation(F.col("evidence_quote")).alias("relation"), P.has_cancer(F.col("evidence_quote")).alias("cancer"))


