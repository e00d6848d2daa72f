"""Model output: tolerant JSON, flattening, checks, label probabilities."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_object(text: str | None) -> str | None:
    """The first balanced object outside code fences, quotes respected; null if none closes."""
    if not text:
        return None
    t = re.sub(r"```(?:json)?", "", text)
    start = t.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(t)) if start >= 0 else ():
        c = t[i]
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return t[start : i + 1]
    return None


def tolerant(text: str | None) -> object:
    """JSON as it stands; with straight quotes, bare words quoted and trailing commas dropped; with missing
    commas put in; as a Python literal. None if nothing helps."""
    if text is None:
        return None
    folded = text.translate(str.maketrans("“”‘’", "\"\"''"))
    plain = re.sub(r",\s*([}\]])", r"\1", re.sub(r":\s*(N/A|None|n/a)\s*([,}])", r': "N/A"\2', folded))
    commas = re.sub(r'(["\d}\]]|true|false|null)\s*\n\s*"', r'\1,\n"', plain)
    for t in (text, plain, commas):
        try:
            return json.loads(t)
        except ValueError:
            continue
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, good = [], []
        for text in batch.column(1).to_pylist():
            value = tolerant(text) if text is not None and text.lstrip()[:1] in "{[\"'" else None
            if value is None and text:
                value = tolerant(first_object(text))
            good.append(value is not None)
            found = {}
            stack = [("", value)]
            while stack:
                path, v = stack.pop()
                if isinstance(v, dict):
                    stack += [(f"{path} {k}" if path else str(k), x) for k, x in v.items()]
                elif path:
                    found[path] = v if v is None or isinstance(v, str) else json.dumps(v)
            out.append(list(found.items()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(out, pa.map_(pa.string(), pa.string()))], names=["k", "parsed", "fields"])


def flatten(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, parsed, fields): the scalars of a nested output by their names joined with a space. Only texts that
    are no plain JSON object would need Python, but nesting of any depth does."""
    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_flat, f"k {kind}, parsed boolean, fields map<string,string>")
    return out.withColumnRenamed("k", key)


def schema_issues(fields: Column, expected: list[str], allowed: dict[str, list[str]]) -> Column:
    """Missing keys and values outside their sets, as codes."""
    missing = F.transform(F.array_except(F.array(*map(F.lit, expected)), F.map_keys(fields)), lambda k: F.concat(F.lit("MISSING:"), k))
    bad = [F.when(fields[k].isNotNull() & ~F.lower(F.trim(fields[k])).isin(v), F.lit(f"INVALID:{k}")) for k, v in allowed.items()]
    return F.concat(missing, F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))


def fill(fields: Column, defaults: dict[str, str]) -> Column:
    """Defaults where a key is missing or blank."""
    kept = F.map_filter(fields, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    base = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(kept, k)), kept)


def binary_audit(yes: Column, no: Column) -> dict[str, Column]:
    """From two logits (or logs of probabilities): normalised probabilities, entropy in nats, margin; no sentinels."""
    p = 1 / (1 + F.exp(no - yes))
    h = lambda q: F.when(q > 0, -q * F.log(q)).otherwise(0.0)
    return {"p_yes": p, "p_no": 1 - p, "entropy": h(p) + h(1 - p), "margin": F.abs(2 * p - 1)}


def chunk_text(raw: Column, keys: tuple[str, ...] = ("text", "chunk", "sentence", "content", "abstract")) -> Column:
    """A JSON string, or the first of the keys that an object has; null for anything else."""
    from functools import reduce

    of_object = F.coalesce(*(F.get_json_object(raw, f"$.{k}") for k in keys))
    of_string = F.when(F.trim(raw).startswith('"'), F.from_json(F.concat(F.lit('{"t":'), raw, F.lit("}")), "t string")["t"])
    return reduce(F.coalesce, [of_object, of_string])


def load_chunks(df: DataFrame, raw: str = "raw_chunk", least: int = 100) -> DataFrame:
    """Chunks with their text; a chunk without one is an error, as places are provenance, and few chunks a warning."""
    import warnings

    text = chunk_text(F.col(raw))
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    if (n := df.count()) < least:
        warnings.warn(f"only {n} chunks", stacklevel=2)
    return df.withColumn("text", F.when(empty, F.raise_error(F.lit("an empty chunk"))).otherwise(text))
