"""Queries of the training-data operators; __spark_entry__.py adds them where this subpackage is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import containers, encode, neardup, pieces, pii, sentences, splits, stuffing

NOTES, CLAIMS = "rebuilt_notes_by_noteid", "agent2_claims_pair_level"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.related_patients(table(spark, sf_dir, NOTES))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split(table(spark, sf_dir, NOTES), table(spark, sf_dir, "split_targets")).select("_run_row_index", "split_name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, NOTES), "_run_row_index", "Clean_note_text")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(table(spark, sf_dir, NOTES), "_run_row_index", "Clean_note_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(table(spark, sf_dir, NOTES), "_run_row_index", "Clean_note_text")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_pieces(table(spark, sf_dir, NOTES), "_run_row_index", "Clean_note_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, sf_dir, NOTES), "_run_row_index", "Clean_note_text")


_PII = ((NOTES, "_run_row_index", "Clean_note_text", "note"), (CLAIMS, "claim_id", "evidence_quote", "claim"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        pii.pii_spans(table(spark, sf_dir, name), key, text, quote=src == "claim").select(F.lit(src).alias("src"), "row_key", "start_pos", "end_pos", "pii_type")
        for name, key, text, src in _PII
    ]
    return found[0].unionByName(found[1])


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = [
        pii.pii_masked(table(spark, sf_dir, name), key, text, SECRET, quote=src == "claim").select(F.lit(src).alias("src"), "row_key", "masked")
        for name, key, text, src in _PII
    ]
    return done[0].unionByName(done[1])


#: For the queries only; who masks real texts brings a key of their own.
SECRET = b"a key for the queries of this repository"


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.decode(p7_ids(spark, sf_dir), "doc_id", "ids")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.pack(encode.sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p2_found, p2_groups, p4_found, p4_pieces, p5_found, p6_found, p6_masked, p7_ids, p7_decoded, p8_containers, p9_found)
}

_ID = "CASE WHEN regexp_matches({0}, '[0-9]') THEN regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\.0$', '') END"

SQL = {
    "p1_found": f"""
WITH RECURSIVE ties AS (
  SELECT DISTINCT {_ID.format('PAT_ID')} AS p, {_ID.format('NOTE_ID')} AS n FROM rebuilt_notes_by_noteid),
edges AS (SELECT DISTINCT x.p AS a, y.p AS b FROM ties x JOIN ties y ON x.n = y.n AND x.p <> y.p),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT DISTINCT a AS pat_a, b AS pat_b FROM reach WHERE a < b""",
    "p2_found": """
WITH w AS (SELECT _run_row_index AS r, regexp_extract_all(lower(Clean_note_text), '[\\p{L}\\p{N}]+') AS t FROM rebuilt_notes_by_noteid WHERE Clean_note_text IS NOT NULL),
s AS (SELECT r, list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM w WHERE len(t) >= 20),
x AS (SELECT r, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.r AS row_a, b.r AS row_b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2)
SELECT row_a, row_b FROM p WHERE c * 10 >= 6 * (n - c)""",
    "p4_found": """
SELECT _run_row_index, CASE WHEN regexp_matches(Clean_note_text, '[^\\s\\x{a0}.!?。！？।؟]{1000}[^\\s\\x{a0}.!?。！？।؟]{1000}[^\\s\\x{a0}.!?。！？।؟]{1000}[^\\s\\x{a0}.!?。！？।؟]{1000}[^\\s\\x{a0}.!?。！？।؟]')
  THEN 'forced' ELSE 'natural' END AS cut_kind
FROM rebuilt_notes_by_noteid WHERE length(Clean_note_text) > 4000""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
