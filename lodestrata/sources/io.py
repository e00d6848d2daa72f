"""Scans and sinks."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

NOTES = T.StructType([T.StructField(c, T.StringType()) for c in ("PAT_ID", "PAT_ENC_CSN_ID", "NOTE_ID", "DATE_OF_SERVIC_DTTM", "SPEC_NOTE_TIME_DTTM", "CONTACT_DATE", "CONTACT_NUM", "Clean_note_text")])
TIMES = ("DATE_OF_SERVIC_DTTM", "SPEC_NOTE_TIME_DTTM", "CONTACT_DATE")
# The order of the notes.
ORDER = ("PAT_ID", "PAT_ENC_CSN_ID", "DATE_OF_SERVIC_DTTM", "SPEC_NOTE_TIME_DTTM", "CONTACT_NUM", "NOTE_ID")


def text_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Every column as text, blanks kept."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\x00").option("emptyValue", "")
    return (reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)).na.fill("")


def load_notes(df: DataFrame, text: str = "Clean_note_text", order: tuple[str, ...] = ORDER, keep_null: bool = False, ties: str | None = None) -> DataFrame:
    """Rows whose text is blank dropped (null ones too, unless kept), times parsed or null, and a dense
    _run_row_index in the order of the columns there are; ties keep the export's order, which is that of a column or, as
    read from a file, that of the rows.

    The index is made of ranges: rows are ranked within range partitions and shifted by the sizes of those before, as one
    window over all rows would put them into one task."""
    times = [c for c in TIMES if c in df.columns and dict(df.dtypes)[c] == "string"]
    out = df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in times})
    if ties is None:
        out = out.withColumn("_export", F.monotonically_increasing_id())
    said = F.col(text).rlike(r"(?U)\S")
    out = out.where(F.col(text).isNull() | said) if keep_null else out.where(said)
    return dense_index(out, [*(F.col(c).asc_nulls_last() for c in order if c in df.columns), F.col(ties or "_export").asc()], "_run_row_index").drop("_export")


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers 0 to n - 1 in the given order, ties in any order."""
    from ..session import cut

    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return parts.join(before, "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """S3: a JSON object of lists as (feature, term), lower case."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return one.select(F.explode("m").alias("feature", "terms")).select("feature", F.explode("terms").alias("term")).select("feature", F.lower("term").alias("term"))


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of {name, is_group_a} as (term, name, group_a)."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<name:string,is_group_a:boolean>>").alias("m"))
    rows = one.select(F.explode("m").alias("term", "v"))
    return rows.select(F.lower("term").alias("term"), F.coalesce("v.name", "term").alias("name"), F.coalesce("v.is_group_a", F.lit(False)).alias("group_a"))


def concepts_or(spark: SparkSession, path: str, curated: dict[str, tuple[str, ...]]) -> DataFrame:
    """The concepts of a file, or, where there is none, curated terms by name, none of them of group A."""
    try:
        return concepts(spark, path)
    except AnalysisException:
        return spark.createDataFrame([(t.lower(), name, False) for name, terms in curated.items() for t in terms], "term string, name string, group_a boolean")


def pick_by_invariant(spark: SparkSession, paths: list[str], columns: list[str], check) -> str:
    """The first file that has the columns (case aside) and passes the check; only its header is read before."""
    for p in paths:
        df = text_csv(spark, p)
        if {c.lower() for c in columns} <= {c.lower() for c in df.columns} and check(df):
            return p
    raise ValueError("no file fits")


def build_or_load(spark: SparkSession, path: str, build) -> DataFrame:
    """H7: the table at a path, built and written first where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.parquet(path)
        return spark.read.parquet(path)


def contract_violations(df: DataFrame, key: str, not_blank: list[str], whole: list[str]) -> DataFrame:
    """H3: (key, violations): cells that must not be blank, and cells that must be whole numbers of 0 or more."""
    n = lambda c: F.col(c).try_cast("double")
    codes = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"BLANK:{c}")) for c in not_blank]
    codes += [F.when(~F.coalesce((n(c) >= 0) & (n(c) == F.floor(n(c))), F.lit(False)), F.lit(f"NO_WHOLE_NUMBER:{c}")) for c in whole]
    return df.select(key, F.array_compact(F.array(*codes)).alias("violations")).where("size(violations) > 0")


def write_by_status(df: DataFrame, path: str, status: str = "status") -> None:
    """K1: one folder for each status."""
    df.write.mode("overwrite").partitionBy(status).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    """K2."""
    df.write.mode("append").json(path)


def resume(todo: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """K3: rows of a run that its output does not hold yet (all, if there is no output)."""
    spark = todo.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return todo
    return todo.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """K4: (path, length, sha256) of the files of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def latex_table(rows: list[tuple], header: list[str], caption: str) -> str:
    """K5: a small report as a LaTeX table."""
    esc = lambda v: re.sub(r"([&%$#_{}])", r"\\\1", "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v))
    body = "\n".join(" & ".join(map(esc, r)) + r" \\" for r in rows)
    return f"\\begin{{table}}\n\\caption{{{esc(caption)}}}\n\\begin{{tabular}}{{{'l' * len(header)}}}\n\\hline\n{' & '.join(map(esc, header))} \\\\\n\\hline\n{body}\n\\hline\n\\end{{tabular}}\n\\end{{table}}\n"


def tagged(text: Column, spans: Column, open_: str = "[[", between: str = "|", close: str = "]]") -> Column:
    """K7: the text with each span of array<struct(start, end, tag)> (0-based, in order, apart) as [[words|TAG]]."""
    cut = lambda a, b: text.substr(a + 1, b - a)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["out"], cut(s["at"], x["start"]), F.lit(open_), cut(x["start"], x["end"]), F.lit(between), x["tag"], F.lit(close)).alias("out")),
    )
    return F.concat(folded["out"], F.substr(text, folded["at"] + 1))


def html(text: Column, spans: Column) -> Column:
    """K6: the same as coloured HTML, markup in the text escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    marked = tagged(text, spans, "\x02", "\x03", "\x04")
    return F.regexp_replace(safe(marked), "\x02([^\x03]*)\x03([^\x04]*)\x04", r'<mark class="$2">$1</mark>')
