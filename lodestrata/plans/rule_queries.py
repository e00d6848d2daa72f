"""Queries of the rules over notes and claims (S1, M, N, P, V5, X) with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import normalize as N
from ..functions import policy as P
from ..functions import structure as S
from ..functions import vocabulary as V
from ..operators import loop
from ..operators import text as T
from ..session import spread
from ..sources import io
from ..sources.tables import table
from .core_queries import CLAIMS, NOTES, PAIRS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pieces of SQL ------------------------------------------------------------------------------------------------

#: White space and word characters of any script, for an engine whose classes are plain ASCII.
_WS = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_W = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _fold(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '“”‘’', '\"\"'''''), '{_WS}+', ' ', 'g'), ' ')"


def _texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _label(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN ({_texts(V.YES_LABELS)}) THEN 'Yes' WHEN lower(trim({x})) IN ({_texts(V.NO_LABELS)}) THEN 'No' END"


def _any(patterns) -> str:
    return "(?i)\\b(?:" + "|".join(patterns) + ")\\b"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


_LEX = ", ".join(f"('{f}', '{a}', {i})" for f, terms in V.ALIASES.items() for i, a in enumerate(dict.fromkeys(terms)))


def mentions_sql(source: str) -> str:
    """Common tables up to m (r, feature, alias, s, e, t): the mentions of source (r, t), t in lower case."""
    return f"""lex(feature, alias, ord) AS (VALUES {_LEX}), src AS ({source}),
hit AS (SELECT r, t, feature, alias, string_split(t, alias) AS parts FROM src JOIN lex ON contains(t, alias)),
pos AS (SELECT r, t, feature, alias, unnest(list_transform(range(1, len(parts)), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda p: length(p))) AS INTEGER) + CAST(i - 1 AS INTEGER) * length(alias))) AS s FROM hit),
ok AS (SELECT r, feature, alias, s, s + length(alias) AS e FROM pos WHERE (s = 0 OR NOT regexp_matches(substr(t, s, 1), '{_W}')) AND NOT regexp_matches(substr(t, s + length(alias) + 1, 1), '{_W}')),
grp AS (SELECT r, feature, list_reduce(list_transform(list_sort(list({{'s': s, 'l': -length(alias), 'e': e, 'a': alias}})), lambda x: [x]), lambda acc, x: CASE WHEN acc[-1].e <= x[1].s THEN list_concat(acc, x) ELSE acc END) AS k FROM ok GROUP BY r, feature),
flat AS (SELECT r, feature, unnest(k) AS k FROM grp),
m AS (SELECT flat.r, feature, k.a AS alias, CAST(k.s AS INTEGER) AS s, CAST(k.e AS INTEGER) AS e, t FROM flat JOIN src USING (r))"""


_SRC = "SELECT _run_row_index AS r, translate(lower(Clean_note_text), chr(1) || chr(2), '  ') AS t FROM rebuilt_notes_by_noteid WHERE Clean_note_text IS NOT NULL"
_BEFORE = "substr(t, greatest(1, s - {n} + 1), least(s, {n}))"
_AFTER = "substr(t, e + 1, {n})"
_SCOPE = f"regexp_replace(regexp_replace({_BEFORE.format(n=140)}, '(?s)^.*[\\n.;]', ''), '(?is)^.* (?:{'|'.join(V.CONTRAST)}) ', '')"
_LOCAL = f"({_BEFORE.format(n=100)} || substr(t, s + 1, e - s) || {_AFTER.format(n=100)})"
_CLASS = (
    f"CASE WHEN {_has(_SCOPE, _any(V.NEGATED_BEFORE))} OR {_has('regexp_extract(' + _AFTER.format(n=70) + chr(44) + chr(32) + chr(39) + '^[^' + chr(92) + 'n.;]*' + chr(39) + ')', _any(V.NEGATED_AFTER))} THEN 'NEGATED' "
    f"WHEN {_has(_LOCAL, _any(V.PLANNED))} THEN 'PLANNED' WHEN {_has(_LOCAL, _any(V.HYPOTHETICAL))} THEN 'HYPOTHETICAL' WHEN {_has(_LOCAL, _any(V.HISTORICAL))} THEN 'HISTORICAL' ELSE 'AFFIRMED' END"
)


def _notes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, NOTES)


def _m(spark, sf_dir, left: int = 0, right: int = 0) -> DataFrame:
    return T.mentions(spread(_notes(spark, sf_dir)), "_run_row_index", "Clean_note_text", V.ALIASES, left, right)


# --- scan (S1) ----------------------------------------------------------------------------------------------------

_ORDER = ", ".join(f"{c} ASC NULLS LAST" for c in io.ORDER)


@query(f"""
SELECT _run_row_index AS row, row_number() OVER (ORDER BY {_ORDER}, _run_row_index) - 1 AS idx FROM rebuilt_notes_by_noteid WHERE {_strip("coalesce(Clean_note_text, '')")} <> ''""")
def loaded_notes(spark, sf_dir):
    """The run's index over the notes with text, ties in export order."""
    n = _notes(spark, sf_dir).withColumnRenamed("_run_row_index", "row")
    return io.load_notes(n, ties="row").select("row", F.col("_run_row_index").alias("idx"))


@query(f"""
SELECT _run_row_index AS row, row_number() OVER (ORDER BY {_ORDER}, _run_row_index) - 1 AS idx FROM rebuilt_notes_by_noteid WHERE Clean_note_text IS NULL OR {_strip("Clean_note_text")} <> ''""")
def loaded_notes_with_null(spark, sf_dir):
    """The same with null texts kept."""
    n = _notes(spark, sf_dir).withColumnRenamed("_run_row_index", "row")
    return io.load_notes(n, keep_null=True, ties="row").select("row", F.col("_run_row_index").alias("idx"))


# --- mentions (J10, M, P1-P5) -------------------------------------------------------------------------------------


@query(f"WITH {mentions_sql(_SRC)} SELECT r AS _run_row_index, feature, alias, s AS start, e AS \"end\" FROM m")
def phrase_spans(spark, sf_dir):
    """Every mention with its place."""
    return _m(spark, sf_dir)


@query(
    f"WITH {mentions_sql(_SRC)}, c AS (SELECT r, feature, {_CLASS} AS class FROM m) SELECT feature, count(*) AS mentions, count(DISTINCT r) AS notes, "
    + ", ".join(f"count(*) FILTER (class = '{k}') AS {k.lower()}" for k in ("AFFIRMED", "HISTORICAL", "HYPOTHETICAL", "PLANNED", "NEGATED"))
    + " FROM c GROUP BY feature"
)
def affirmed_by_finding(spark, sf_dir):
    """Mentions of each finding by class, and the notes that have any."""
    c = _m(spark, sf_dir, 140, 100).withColumn("class", P.assertion_in(F.col("before"), F.col("alias"), F.col("after")))
    return c.groupBy("feature").agg(
        F.count("*").alias("mentions"), F.count_distinct("_run_row_index").alias("notes"),
        *(F.count_if(F.col("class") == k).alias(k.lower()) for k in ("AFFIRMED", "HISTORICAL", "HYPOTHETICAL", "PLANNED", "NEGATED")),
    )


_DENIED = " OR ".join(f"contains({_BEFORE.format(n=25)}, '{c}')" for c in V.DENIAL_PREFIXES)


@query(
    f"WITH {mentions_sql(_SRC)} SELECT r AS _run_row_index, feature, s AS start, {_has(_BEFORE.format(n=40), _any(V.PRE_NEGATION))} OR {_has(_AFTER.format(n=40), _any(V.POST_NEGATION))} AS negated, {_DENIED} AS denied FROM m"
)
def mention_negation(spark, sf_dir):
    """Cues around each mention, by patterns and as plain texts before it."""
    m = _m(spark, sf_dir, 40, 40)
    return m.select("_run_row_index", "feature", "start", P.negated_in(F.col("before"), F.col("after")).alias("negated"), P.prefix_denied(F.col("before")).alias("denied"))


@query(f"""
WITH {mentions_sql(_SRC)}, d AS (SELECT DISTINCT r, m.feature, m.alias, ord FROM m JOIN lex ON lex.feature = m.feature AND lex.alias = m.alias)
SELECT r AS _run_row_index, feature, CAST(rank AS INTEGER) AS rank, alias FROM (SELECT *, row_number() OVER (PARTITION BY r, feature ORDER BY ord) AS rank FROM d) WHERE rank <= 5""")
def concept_top5(spark, sf_dir):
    """M4, group A: at most the first five aliases, in lexicon order, of each finding in a note."""
    j = _m(spark, sf_dir).select("_run_row_index", "feature", "alias").distinct().join(F.broadcast(T.lexicon(spark, V.ALIASES)), ["feature", "alias"])
    w = Window.partitionBy("_run_row_index", "feature").orderBy("ord")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("_run_row_index", "feature", "rank", "alias")


@query(f"""
WITH {mentions_sql(_SRC)}, g AS (SELECT r, count(*) AS n, list_sort(list({{'s': s, 'l': s - e, 'e': e}})) AS a, list_sort(list({{'l': s - e, 's': s, 'e': e}})) AS b FROM m GROUP BY r)
SELECT r AS _run_row_index, CAST(n AS INTEGER) AS mentions,
  CAST(len(list_reduce(list_transform(a, lambda x: [x]), lambda acc, x: CASE WHEN acc[-1].e <= x[1].s THEN list_concat(acc, x) ELSE acc END)) AS INTEGER) AS leftmost,
  CAST(len(list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: (k.s <= x[1].s AND x[1].s < k.e) OR (k.s <= x[1].e - 1 AND x[1].e - 1 < k.e))) > 0 THEN acc ELSE list_concat(acc, x) END)) AS INTEGER) AS greedy FROM g""")
def mention_cover(spark, sf_dir):
    """M6, M7: mentions of all findings together, overlaps removed in two ways."""
    g = _m(spark, sf_dir).groupBy("_run_row_index").agg(F.collect_list(F.struct("start", "end", "feature")).alias("s"))
    return g.select("_run_row_index", F.size("s").alias("mentions"), F.size(T.leftmost_longest(F.col("s"))).alias("leftmost"), F.size(T.greedy_cover(F.col("s"))).alias("greedy"))


@query(f"""
WITH {mentions_sql(_SRC)} SELECT r AS _run_row_index, feature, alias, s AS char_start, e AS char_end, replace(substr(n.Clean_note_text, greatest(1, s - 24), e + 25 - greatest(0, s - 25)), chr(10), ' ') AS context
FROM m JOIN rebuilt_notes_by_noteid n ON n._run_row_index = m.r""")
def concept_contexts(spark, sf_dir):
    """Each mention with 25 characters on either side, on one line. The text itself is wanted, in its own case, so the
    mentions are joined with it; only notes that have any are."""
    m = _m(spark, sf_dir)
    n = _notes(spark, sf_dir).select("_run_row_index", "Clean_note_text")
    low = F.greatest(F.lit(0), F.col("start") - 25)
    context = F.translate(F.col("Clean_note_text").substr(low + 1, F.col("end") + 25 - low), "\n", " ")
    return m.join(n, "_run_row_index").select("_run_row_index", "feature", "alias", F.col("start").alias("char_start"), F.col("end").alias("char_end"), context.alias("context"))


@query(
    "WITH lex(feature, alias, ord) AS (VALUES " + _LEX + ") SELECT _run_row_index, feature, count(*) AS terms FROM rebuilt_notes_by_noteid JOIN lex ON contains(lower(Clean_note_text), alias) GROUP BY 1, 2"
)
def raw_terms(spark, sf_dir):
    """M3: terms that occur in a note, inside words too."""
    low = _notes(spark, sf_dir).select("_run_row_index", F.lower("Clean_note_text").alias("t")).where("t is not null")
    hits = F.array(*(F.struct(F.lit(f).alias("feature"), sum((F.contains("t", F.lit(a)).cast("bigint") for a in dict.fromkeys(terms)), F.lit(0)).alias("terms")) for f, terms in V.ALIASES.items()))
    return low.select("_run_row_index", F.explode(hits).alias("h")).select("_run_row_index", "h.*").where("terms > 0")


_GROUP_B = {t: name for name, terms in V.RETRIEVAL_TERMS.items() for t in terms}


@query(
    "WITH lex(term, concept, ord) AS (VALUES " + ", ".join(f"('{t}', '{c}', {i})" for i, (t, c) in enumerate(_GROUP_B.items())) + "), "
    f"h AS (SELECT _run_row_index, concept, ord, term, string_split(t, term) AS parts FROM (SELECT _run_row_index, lower(Clean_note_text) AS t FROM rebuilt_notes_by_noteid) JOIN lex ON contains(t, term)) "
    f"SELECT _run_row_index, concept, min_by(term, ord) AS term FROM h WHERE len(list_filter(range(1, len(parts)), lambda i: NOT regexp_matches(right(parts[i], 1), '{_W}') AND NOT regexp_matches(left(parts[i + 1], 1), '{_W}'))) > 0 GROUP BY 1, 2"
)
def concept_group_b(spark, sf_dir):
    """M4, group B, H1: of each other concept the first of its terms that a note has."""
    low = _notes(spark, sf_dir).select("_run_row_index", F.lower("Clean_note_text").alias("t")).where("t is not null")
    first = F.array(*(F.struct(F.lit(c).alias("concept"), F.coalesce(*(F.when(F.col("t").rlike(P.bounded(t)), F.lit(t)) for t in terms)).alias("term")) for c, terms in V.RETRIEVAL_TERMS.items()))
    return low.select("_run_row_index", F.explode(first).alias("h")).select("_run_row_index", "h.*").where("term is not null")


@query(
    "WITH lex(src, feature, alias, ord) AS (VALUES " + ", ".join(f"({k}, '{f}', '{a}', {i})" for k, d in enumerate((V.ALIASES, V.RETRIEVAL_TERMS)) for f, terms in d.items() for i, a in enumerate(terms)) + ") "
    "SELECT alias, feature FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY src, ord, feature) AS rn FROM lex) WHERE rn = 1"
)
def combined_lexicon(spark, sf_dir):
    """M5, H1: aliases and retrieval terms; the first list, then the first place, that has a term owns it."""
    return T.merged_lexicon([T.lexicon(spark, V.ALIASES), T.lexicon(spark, V.RETRIEVAL_TERMS)]).select("alias", "feature")


# --- sections (M15-M17) -------------------------------------------------------------------------------------------


def _line(patterns) -> str:
    return f"(?im)^{_WS}*(?:{'|'.join(patterns)}){_WS}*:??{_WS}*$"


def _at(x: str, pattern: str) -> str:
    return f"CASE WHEN len(string_split_regex({x}, '{pattern}')) > 1 THEN length(string_split_regex({x}, '{pattern}')[1]) + 1 END"


_BOUNDS = f"""b0 AS (SELECT _run_row_index AS r, Clean_note_text AS t, coalesce(list_min([{', '.join(_at('Clean_note_text', _line([p])) for p in V.ROS_LINES)}]),
  list_min([{', '.join(f"nullif(instr(lower(Clean_note_text), '{n}'), 0)" for n in V.ROS_INLINE)}]), 0) AS a FROM rebuilt_notes_by_noteid WHERE Clean_note_text IS NOT NULL),
b1 AS (SELECT *, CASE WHEN substr(t, a + 4, 1) = chr(10) THEN {_at("substr(t, a + 5)", _line(V.ROS_ENDS))} ELSE {_at("('x' || substr(t, a + 5))", _line(V.ROS_ENDS))} - 1 END AS k FROM b0),
b AS (SELECT r, t, a, CASE WHEN a = 0 THEN 0 ELSE coalesce(a + 4 + k, length(t) + 1) END AS z FROM b1),
o AS (SELECT r, CASE WHEN a > 0 THEN substr(t, 1, a - 1) || substr(t, z) ELSE t END AS outside, CASE WHEN a > 0 THEN substr(t, a, z - a) ELSE '' END AS inside FROM b)"""


@query(f"WITH {_BOUNDS} SELECT r AS _run_row_index, CAST(length(inside) AS INTEGER) AS inside, md5(outside) AS outside FROM o")
def section_split(spark, sf_dir):
    """The review of systems, and what is outside it."""
    out, inside = P.split_section(F.col("Clean_note_text"))
    return _notes(spark, sf_dir).where("Clean_note_text is not null").select("_run_row_index", F.length(inside).alias("inside"), F.md5(out).alias("outside"))


def _after_place(e: str) -> str:
    return f"CASE WHEN instr(substr(low, a + 20), '{e}') > 0 THEN a + 19 + instr(substr(low, a + 20), '{e}') END"


@query(f"""
WITH x AS (SELECT _run_row_index AS r, lower(Clean_note_text) AS low, length(Clean_note_text) AS n, coalesce(list_min([{', '.join(f"nullif(instr(lower(Clean_note_text), '{k}'), 0)" for k in V.ROS_NAMES)}]), 0) AS a
  FROM rebuilt_notes_by_noteid WHERE Clean_note_text IS NOT NULL)
SELECT r AS _run_row_index, CAST(a AS INTEGER) AS start, CAST(CASE WHEN a > 0 THEN coalesce(list_min([{', '.join(_after_place(e) for e in V.ROS_NAME_ENDS)}]), n + 1) - a ELSE 0 END AS INTEGER) AS inside FROM x""")
def section_split_by_names(spark, sf_dir):
    """The same by plain texts."""
    t = F.col("Clean_note_text")
    out, inside = P.split_section_by_names(t)
    start = F.when(F.length(inside) > 0, F.coalesce(F.least(*(F.when(F.instr(F.lower(t), n) > 0, F.instr(F.lower(t), n)) for n in V.ROS_NAMES)), F.lit(0))).otherwise(0)
    return _notes(spark, sf_dir).where("Clean_note_text is not null").select("_run_row_index", start.alias("start"), F.length(inside).alias("inside"))


@query(f"""
WITH {_BOUNDS}, {mentions_sql("SELECT r, translate(lower(outside), chr(1) || chr(2), '  ') AS t FROM o")}
SELECT DISTINCT r AS _run_row_index, feature FROM m WHERE NOT ({_has(_BEFORE.format(n=40), _any(V.PRE_NEGATION))} OR {_has(_AFTER.format(n=40), _any(V.POST_NEGATION))})""")
def present_outside(spark, sf_dir):
    """Findings with a mention outside the review of systems that nothing denies."""
    return T.present_outside(spread(_notes(spark, sf_dir)), "_run_row_index", "Clean_note_text", V.ALIASES)


@query(f"""
WITH {_BOUNDS} SELECT r AS _run_row_index, regexp_matches(lower(outside), '{V.MEMBER}[^.;]{{0,100}}{V.CRC}') OR regexp_matches(lower(outside), '{V.CRC}[^.;]{{0,100}}{V.MEMBER}') AS family FROM o""")
def family_history(spark, sf_dir):
    """M17."""
    n = _notes(spark, sf_dir).where("Clean_note_text is not null")
    return n.select("_run_row_index", S.family_history(F.col("Clean_note_text")).alias("family"))


# --- claims (N, P10, P14-P16, V5) ---------------------------------------------------------------------------------


@query(f"""
SELECT claim_id, lower(trim(regexp_replace(replace(feature, '_', ' '), '\\s+', ' ', 'g'))) AS feature, CASE WHEN confidence BETWEEN 1 AND 5 THEN CAST(confidence AS INTEGER) END AS confidence,
  lower({_strip("coalesce(original_inference, '')")}) IN ({_texts(V.BAD_INFERENCE)}) AS no_quotation, length(regexp_replace(coalesce(evidence_quote, ''), '{_WS}+', '', 'g')) > 5 AS usable, {_fold('evidence_quote')} AS folded
FROM agent2_claims_pair_level""")
def claim_fields(spark, sf_dir):
    """N2, N6, N7 without decomposition, N9, G12, H2."""
    c = table(spark, sf_dir, CLAIMS)
    return c.select(
        "claim_id", N.norm_feature(F.col("feature")).alias("feature"), N.confidence(F.col("confidence")).alias("confidence"), N.no_quotation(F.col("original_inference")).alias("no_quotation"),
        N.usable_quote(F.col("evidence_quote")).alias("usable"), N.fold_text(F.col("evidence_quote")).alias("folded"),
    )


@query(f"""
SELECT claim_id, length({_strip("coalesce(original_inference, '')")}) > 5 AND lower({_strip("coalesce(original_inference, '')")}) NOT IN ({_texts(V.STOP_VALUES)})
  AND NOT ({' OR '.join(f"starts_with(lower({_strip(chr(99) + 'oalesce(original_inference, ' + chr(39) * 2 + ')')}), '{p}')" for p in V.STOP_PREFIXES)}) AS usable FROM agent2_claims_pair_level""")
def usable_inference(spark, sf_dir):
    """N8."""
    return table(spark, sf_dir, CLAIMS).select("claim_id", N.usable_inference(F.col("original_inference")).alias("usable"))


def _contains_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({_fold(f'coalesce({x}, {chr(39) * 2})')}, '{t}')" for t in terms) + ")"


_FAM = f"feature = '{V.FAMILY}'"
_SEMANTIC = (
    ("assertion", f"lower({_strip(chr(99) + 'oalesce(assertion_status, ' + chr(39) * 2 + ')')}) NOT IN ('affirmed', 'historical')"), ("family", f"{_FAM} AND lower(coalesce(experiencer, '')) <> 'family_member'"),
    ("relation", f"{_FAM} AND NOT {_contains_any('relation_found', V.RELATION_TERMS)}"), ("cancer", f"{_FAM} AND NOT {_contains_any('cancer_type_found', V.CRC_TERMS)}"),
    ("evidence_relation", f"{_FAM} AND NOT {_contains_any('evidence_quote', V.RELATION_TERMS)}"), ("evidence_cancer", f"{_FAM} AND NOT {_contains_any('evidence_quote', V.CRC_TERMS)}"),
    ("patient", f"NOT {_FAM} AND lower(coalesce(experiencer, '')) <> 'patient'"),
)


def _codes(pairs) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in pairs) + "], lambda x: x IS NOT NULL), ';')"


@query(f"SELECT claim_id, {_codes((P.SEMANTIC[k], c) for k, c in _SEMANTIC)} AS codes FROM agent2_claims_pair_level WHERE {_label('prediction')} = 'Yes'")
def semantic_failures(spark, sf_dir):
    """P14 over positive claims."""
    c = table(spark, sf_dir, CLAIMS).where(N.label(F.col("prediction")) == "Yes")
    codes = P.semantic_failures(*(F.col(x) for x in ("feature", "evidence_quote", "assertion_status", "experiencer", "relation_found", "cancer_type_found")))
    return c.select("claim_id", F.array_join(codes, ";").alias("codes"))


def _grounded(spark, sf_dir) -> DataFrame:
    """Claims with whether their inference's quotation is in the note, folded (H12's first part, H13)."""
    c = table(spark, sf_dir, CLAIMS)
    n = _notes(spark, sf_dir).select("_run_row_index", N.fold_text(F.col("Clean_note_text")).alias("_note"))
    q = N.strip(F.coalesce("evidence_quote", F.lit("")))
    return c.join(n, "_run_row_index", "left").withColumn("grounded", (F.length(q) > 5) & F.coalesce(F.contains("_note", N.fold_text(F.col("evidence_quote"))), F.lit(False))).drop("_note")


_CLAIM_SQL = f"""c AS (SELECT claim_id, feature, {_label('prediction')} AS l, confidence AS conf, {_strip("coalesce(evidence_quote, '')")} AS inf, length({_strip("coalesce(evidence_quote, '')")}) > 5 AND coalesce(contains({_fold('n.Clean_note_text')}, {_fold('evidence_quote')}), false) AS g,
  CASE lower({_strip("coalesce(note_section, '')")}) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SECTION_ALIASES.items())} ELSE lower({_strip("coalesce(note_section, '')")}) END AS sec, lower({_strip("coalesce(experiencer, '')")}) AS exp,
  CASE lower({_strip("coalesce(assertion_status, '')")}) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ASSERTION_ALIASES.items())} ELSE lower({_strip("coalesce(assertion_status, '')")}) END AS asr,
  note_section, experiencer, assertion_status, evidence_quote FROM agent2_claims_pair_level LEFT JOIN rebuilt_notes_by_noteid n USING (_run_row_index)),
k AS (SELECT *, (lower(inf) IN ({_texts(V.BAD_INFERENCE)}) OR NOT g) AS bad, (lower(inf) IN ({_texts(V.BAD_INFERENCE)}) OR {' OR '.join(f"starts_with(lower(inf), '{p}')" for p in V.ABSENCE_PREFIXES)}) AS absent,
  (conf IS NULL OR conf NOT BETWEEN 1 AND 5) AS off, sec IN ({_texts(V.SECTIONS)}) AS sok, exp IN ({_texts(V.EXPERIENCERS)}) AS eok, asr IN ({_texts(V.ASSERTIONS)}) AS aok FROM c)"""
_ISSUE_SQL = (
    ("confidence", "off"), ("section", "NOT sok"), ("experiencer", "NOT eok"), ("assertion", "NOT aok"), ("positive_assertion", "l = 'Yes' AND asr NOT IN ('affirmed', 'historical')"),
    ("positive_patient", f"l = 'Yes' AND NOT {_FAM} AND exp <> 'patient'"), ("positive_family", f"l = 'Yes' AND {_FAM} AND exp <> 'family_member'"), ("ungrounded", "l = 'Yes' AND bad"),
    ("relation", f"l = 'Yes' AND {_FAM} AND inf <> '' AND NOT regexp_matches(lower(inf), '{V.MEMBER}')"), ("cancer", f"l = 'Yes' AND {_FAM} AND inf <> '' AND NOT regexp_matches(lower(inf), '{V.CRC}')"),
    ("negative_assertion", "l = 'No' AND asr NOT IN ('negated', 'absent', 'unknown')"), ("denial", "l = 'No' AND asr = 'negated' AND bad"), ("leftover", "l = 'No' AND asr <> 'negated' AND NOT absent"),
)
_ISSUES = f"CASE WHEN l IS NULL THEN '{S.ISSUES['label']}' ELSE {_codes((S.ISSUES[k], c) for k, c in _ISSUE_SQL)} END"


def _claim() -> dict:
    return {"label": N.label(F.col("prediction")), "confidence": F.col("confidence"), "inference": F.col("evidence_quote"), "section": F.col("note_section"), "experiencer": F.col("experiencer"), "assertion": F.col("assertion_status")}


@query(f"WITH {_CLAIM_SQL} SELECT claim_id, {_ISSUES} AS issues FROM k")
def metadata_issues(spark, sf_dir):
    """P15 over the claims (their table has no durations); a quotation counts as in the note if its folded form is."""
    return _grounded(spark, sf_dir).select("claim_id", F.array_join(S.metadata_issues(_claim(), F.col("feature"), F.col("grounded")), ";").alias("issues"))


@query(f"""
WITH {_CLAIM_SQL}, d AS (SELECT *, l = 'No' AND {_ISSUES} <> '' AS due, asr = 'negated' AND NOT bad AS den FROM k)
SELECT claim_id, CASE WHEN NOT den THEN '{V.NOT_DOCUMENTED}' ELSE evidence_quote END AS inference, CASE WHEN NOT den THEN 'none' WHEN sok THEN sec ELSE 'unknown' END AS section,
  CASE WHEN NOT den THEN 'unknown' WHEN eok THEN exp ELSE 'unknown' END AS experiencer, CASE WHEN NOT den THEN 'unknown' ELSE 'negated' END AS assertion,
  {_codes((("invalid_confidence->1", "off"), ("assertion_alias_normalized", f"den AND asr <> lower({_strip(chr(99) + 'oalesce(assertion_status, ' + chr(39) * 2 + ')')})"), ("invalid_section->unknown", "den AND NOT sok"), ("invalid_experiencer->unknown", "den AND NOT eok"),
           ("unsupported_negative_inference->not_documented", f"NOT den AND inf <> '{V.NOT_DOCUMENTED}'"), ("negative_section->none", "NOT den AND sec <> 'none'"), ("negative_experiencer->unknown", "NOT den AND exp <> 'unknown'"), ("negative_assertion->unknown", "NOT den AND asr <> 'unknown'")))} AS changes
FROM d WHERE due""")
def negatives_normalised(spark, sf_dir):
    """The "No" claims that had issues, as rewritten, and what was changed."""
    g = _grounded(spark, sf_dir)
    new, changes, ok = S.normalise_negative(_claim(), F.col("feature"), F.col("grounded"))
    due = (N.label(F.col("prediction")) == "No") & (F.size(S.metadata_issues(_claim(), F.col("feature"), F.col("grounded"))) > 0)
    return g.where(due).select("claim_id", *(new[k].alias(k) for k in ("inference", "section", "experiencer", "assertion")), F.array_join(changes, ";").alias("changes"))


_ALIAS_OF = "CASE " + " ".join(
    f"WHEN feature = '{f}' THEN list_aggregate(list_transform(list_filter([{_texts(dict.fromkeys(terms))}], lambda a: contains(lower(evidence_quote), a)), lambda a: lpad(CAST(length(a) AS VARCHAR), 4, '0') || a), 'max')[5:]" for f, terms in V.ALIASES.items()
) + " END"
_ALIAS_AT = f"length(regexp_extract(lower(q), '^((?s:.*?))(?:^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])' || al || '(?:$|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])', 1))"


@query(f"""
WITH q AS (SELECT claim_id, feature, evidence_quote AS q, {_ALIAS_OF} AS al FROM agent2_claims_pair_level WHERE length(evidence_quote) > 5),
x AS (SELECT *, coalesce(regexp_matches(lower(q), '(?:^|{_W.replace('[', '[^')})' || al || '(?:$|{_W.replace('[', '[^')})'), false) AS hit FROM q),
y AS (SELECT *, CASE WHEN hit THEN CASE WHEN starts_with(lower(q), al) AND NOT regexp_matches(substr(q, length(al) + 1, 1), '{_W}') THEN 0 ELSE {_ALIAS_AT} + 1 END END AS s FROM x),
z AS (SELECT *, regexp_replace(regexp_replace(substr(q, greatest(1, s - 59), least(s, 60)), '(?s)^.*[\\n.;]', ''), '(?is)^.* (?:{'|'.join(V.CONTRAST)}) ', '') AS bef FROM y)
SELECT claim_id, al AS alias, CASE WHEN {_strip('q')} = '' THEN 'EMPTY_CANDIDATE' ELSE array_to_string(list_sort(list_filter([
  CASE WHEN hit AND {_has('bef', _any([V.ADVICE]))} THEN 'ADVICE_OR_PREVENTION_CONTEXT' END, CASE WHEN {_has('q', _any([V.CONDITIONAL]))} THEN 'CONDITIONAL_OR_HYPOTHETICAL_CONTEXT' END,
  CASE WHEN al IS NOT NULL AND regexp_matches({_fold('q')}, al || '\\s*[:=\\-]\\s*none\\b') THEN 'EXPLICIT_NONE_CONTEXT' END, CASE WHEN al = 'straining' AND NOT {_has('q', _any([V.BOWEL]))} THEN 'STRAINING_NOT_BOWEL_CONTEXT' END,
  CASE WHEN feature = 'Rectal bleeding' AND al = 'occult blood' AND {_has('q', _any([V.TEST_ORDER]))} AND NOT {_has('q', _any([V.POSITIVE_RESULT]))} THEN 'TEST_OR_ORDER_ONLY' END,
  CASE WHEN feature = 'Weight loss' AND {_has('q', _any([V.LOSS_PURPOSE]))} THEN 'WEIGHT_LOSS_GOAL_OR_PURPOSE' END], lambda c: c IS NOT NULL)), ';') END AS codes FROM z""")
def context_failures(spark, sf_dir):
    """All codes, for the longest alias of the claim's own finding in its quotation."""
    alias = F.lit(None).cast("string")
    for f, terms in V.ALIASES.items():
        alias = F.when(F.col("feature") == f, S.longest_alias(F.col("evidence_quote"), tuple(dict.fromkeys(terms)))).otherwise(alias)
    c = table(spark, sf_dir, CLAIMS).where(F.length("evidence_quote") > 5).select("claim_id", "feature", "evidence_quote", alias.alias("alias"))
    return c.select("claim_id", "alias", F.array_join(P.context_failures(F.col("feature"), F.col("alias"), F.col("evidence_quote")), ";").alias("codes"))


@query("""
WITH c AS (SELECT _run_row_index, feature, min_by(evidence_quote, claim_id) AS q, min_by(note_section, claim_id) AS sec, min_by(assertion_status, claim_id) AS asr FROM agent2_claims_pair_level GROUP BY 1, 2)
SELECT pair_id, CASE WHEN operational_failure THEN 'REFINEMENT_ERROR' WHEN agent2_prediction = 'Yes' AND final_loop_prediction = 'No' THEN 'REJECTED' WHEN agent2_prediction = 'No' AND final_loop_prediction = 'Yes' THEN 'RECOVERED'
  WHEN agent2_prediction IS DISTINCT FROM final_loop_prediction THEN 'LABEL_CHANGED' WHEN coalesce(q, '') <> coalesce(final_loop_evidence, '') THEN 'EVIDENCE_CORRECTED'
  WHEN lower(coalesce(sec, '')) <> lower(coalesce(final_loop_section, '')) OR lower(coalesce(asr, '')) <> lower(coalesce(final_loop_assertion, '')) THEN 'METADATA_CORRECTED' ELSE 'CONFIRMED' END AS change
FROM verge_final_pair_level LEFT JOIN c USING (_run_row_index, feature)""")
def change_types(spark, sf_dir):
    """V5: the loop's result against the first claim of its note and finding."""
    first = [F.min_by(x, "claim_id").alias(a) for x, a in (("evidence_quote", "q"), ("note_section", "sec"), ("assertion_status", "asr"))]
    c = table(spark, sf_dir, CLAIMS).groupBy("_run_row_index", "feature").agg(*first)
    differ = lambda a, b: F.lower(F.coalesce(a, F.lit(""))) != F.lower(F.coalesce(b, F.lit("")))
    evidence = F.coalesce("q", F.lit("")) != F.coalesce("final_loop_evidence", F.lit(""))
    kind = loop.change_type(F.col("agent2_prediction"), F.col("final_loop_prediction"), evidence, differ("sec", "final_loop_section") | differ("asr", "final_loop_assertion"), F.col("operational_failure"))
    return table(spark, sf_dir, PAIRS).join(c, ["_run_row_index", "feature"], "left").select("pair_id", kind.alias("change"))
