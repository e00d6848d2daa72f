"""Encoding of a corpus with a public tokenizer (problem 7): every distinct word is encoded once.

Texts are cut once into pre-tokens by the tokenizer's own pattern (byte-level BPE never merges across them) and exploded
into rows (block, word, places): a block is a run of a task's texts of about BLOCK_CHARS characters, and the places of a
word in its block travel as one row of gaps, a byte each, so that the most frequent word has one row a block rather than
one an occurrence. One shuffle by word brings all places of a word to the task that encodes it, once, and hangs its ids
on them; a second shuffle by block brings them back, and the texts are put together by position. The first one is a
rebalance, so adaptive execution cuts the partition of a word that is in every block into several (each of them encodes
that word once more) and joins small ones. ``sizes`` goes the same way with numbers in place of ids.

Decoding joins the table of the tokens' bytes and reads the bytes as UTF-8.

Defined results: a null and an empty text both have no ids; special tokens' strings are ordinary text; repeated rows
come out each, repeated ids too; extra columns are ignored. A text longer than a block is a block of its own: it is a
row of that size in any case. Blocks are numbered by their task and order, so the rows of a task must come in the same
order when it is run again, as those of a scan do.
"""

from __future__ import annotations

import base64
import importlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.tiktoken"
BLOCK_CHARS = 4_000_000
CACHE_WORDS = 1_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public file lies; a path is taken as it is."""
    return name if "/" in name else importlib.import_module("public_tokenizers").path(name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def cutters():
    """(for ASCII texts, for all texts): two functions that cut a text into its pre-tokens."""
    import public_tokenizers
    import regex

    white = r" \t\n\r\f\v"  # for the other module \s holds four control characters more
    plain = public_tokenizers.PATTERN
    for name, chars in ((r"[^\s\p{L}\p{N}]", rf"[^{white}A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", f"[{white}]"), (r"\S", f"[^{white}]")):
        plain = plain.replace(name, chars)
    return re.compile(plain).findall, regex.compile(public_tokenizers.PATTERN).findall


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column of binaries that lie one after another in data, the k-th ending at byte ends[k]."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _places(flat: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(word, gaps, far): the distinct words of a block with their places, as steps from the one before; a step of 255
    or more has 255 in gaps and itself in far, four bytes long."""
    coded = pa.array(flat, pa.string()).dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
    step = np.diff(order, prepend=0)
    begins = np.concatenate([[0], ends[:-1]])
    step[begins] = order[begins]
    long = step >= 255
    far = np.cumsum(long)[ends - 1] * 4
    return coded.dictionary, _slices(np.minimum(step, 255).astype(np.uint8), ends), _slices(step[long].astype("<u4").view(np.uint8), far)


def _exploded(kind: pa.DataType):
    """(block, word, gaps, far, docs, lens): a row for each distinct word of a block and one with the block's ids and
    their numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, full = cutters()
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, first = batch.column(1).to_pylist(), 0
            while first < len(texts):
                flat: list[str] = []
                lens: list[int] = []
                size = 0
                for text in texts[first:]:
                    if text:
                        size += len(text)
                        if size > BLOCK_CHARS and lens:
                            break
                        found = (plain if text.isascii() else full)(text)
                        flat += found
                        lens.append(len(found))
                    else:
                        lens.append(0)
                word, gaps, far = _places(flat) if flat else (pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.binary()))
                n = len(word)
                # the block's own row goes to a partition by the block's number
                word = pa.concat_arrays([word.cast(pa.string()), pa.array([f"\0{block}"])])
                none = lambda t: pa.nulls(n, t)
                docs = pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), batch.column(0).slice(first, len(lens)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, block, np.int64)), word, pa.concat_arrays([gaps, pa.array([b""])]), pa.concat_arrays([far, pa.array([b""])]),
                        pa.concat_arrays([none(pa.list_(kind)), docs.cast(pa.list_(kind))]), pa.concat_arrays([none(pa.list_(pa.int32())), pa.array([lens], pa.list_(pa.int32()))]),
                    ],
                    names=["block", "word", "gaps", "far", "docs", "lens"],
                )
                first += len(lens)
                block += 1

    return run


def _encoded(path: str, count: bool):
    """The rows with their word's ids, or the number of them, in place of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, known = encoding(path).encode_ordinary, {}
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            if len(known) > CACHE_WORDS:
                known.clear()
            ids = []
            for w in coded.dictionary.to_pylist():
                if w not in known:
                    known[w] = [] if w[0] == "\0" and len(w) > 1 and w[1:].isdigit() else one(w)
                ids.append(known[w])
            values = pa.array([len(x) for x in ids], pa.int32()) if count else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), values.take(coded.indices), *(batch.column(c) for c in ("gaps", "far", "docs", "lens"))], names=["block", "ids", "gaps", "far", "docs", "lens"]
            )

    return run


def _bytes(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, their number in each row) of a column of binaries."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    width = np.dtype(kind).itemsize
    return flat.copy().view(kind), np.diff(offsets) // width


def _whole(count: bool):
    """(id, ids or number) of the texts of a block."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        columns = {c: group.column(c).combine_chunks() if isinstance(group.column(c), pa.ChunkedArray) else group.column(c) for c in group.column_names}
        own = columns["docs"].is_valid()
        own_row = columns["docs"].filter(own), columns["lens"].filter(own)
        docs, lens = own_row[0].flatten(), own_row[1].flatten().to_numpy()
        words = pa.compute.invert(own)
        gaps, times = _bytes(columns["gaps"].filter(words), "u1")
        far, _ = _bytes(columns["far"].filter(words), "<u4")
        step = gaps.astype(np.int64)
        step[gaps == 255] = far
        ends = np.cumsum(times)
        place = np.cumsum(step)
        before = np.concatenate([[0], place])[ends - times]
        place -= np.repeat(before, times)
        row = np.empty(len(place), np.int64)
        row[place] = np.repeat(np.arange(len(times)), times)
        text = np.concatenate([[0], np.cumsum(lens)])
        values = columns["ids"].filter(words)
        if count:
            n = np.concatenate([[0], np.cumsum(values.to_numpy()[row] if len(row) else np.zeros(0, np.int64))])
            return pa.table({"id": docs, "n": pa.array((n[text[1:]] - n[text[:-1]]).astype(np.int32))})
        size = values.value_lengths().to_numpy().astype(np.int64)
        flat = values.flatten().to_numpy()
        size, start = size[row], (np.cumsum(size) - size)[row]
        done = np.concatenate([[0], np.cumsum(size)])
        out = flat[np.repeat(start - done[:-1], size) + np.arange(done[-1])] if len(row) else np.zeros(0, np.int32)
        return pa.table({"id": docs, "ids": pa.ListArray.from_arrays(pa.array(done[text].astype(np.int32)), pa.array(out, pa.int32()))})

    return run


def _through(df: DataFrame, key: str, text: str, tokenizer: str, count: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType.simpleString()
    path = tokenizer_path(tokenizer)
    base = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"block bigint, {{}}, gaps binary, far binary, docs array<{kind}>, lens array<int>"
    rows = base.mapInArrow(_exploded(to_arrow_type(df.schema[key].dataType)), schema.format("word string")).hint("rebalance", F.col("word"))
    known = rows.mapInArrow(_encoded(path, count), schema.format("ids int" if count else "ids array<int>"))
    return known.groupBy("block").applyInArrow(_whole(count), f"id {kind}, {'n int' if count else 'ids array<int>'}")


def encode(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids) of every row."""
    return _through(df, key, text, tokenizer, False).withColumnRenamed("id", key)


def sizes(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every row, without its ids."""
    return _through(df, key, text, tokenizer, True).select(F.col("id").alias(key), F.col("n").alias("n_tokens"))


def token_bytes(spark: SparkSession, tokenizer: str = TOKENIZER) -> DataFrame:
    """(token, hex): the table of the tokens' bytes, of the vocabulary's fixed size."""
    rows = [(i, b.hex()) for b, i in ranks(tokenizer_path(tokenizer)).items()]
    return spark.createDataFrame(rows, "token int, hex string")


def decode(df: DataFrame, key: str, ids: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, text): the texts of lists of ids, null where an id has no bytes; no ids give an empty text."""
    flat = df.select(F.col(key).alias("id"), F.posexplode(ids).alias("pos", "token"))
    named = flat.join(F.broadcast(token_bytes(df.sparkSession, tokenizer)), "token", "left")
    joined = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "hex"))).alias("p"))
    text = F.when(F.exists("p", lambda x: x["hex"].isNull()), None).otherwise(F.decode(F.unhex(F.array_join(F.col("p.hex"), "")), "UTF-8"))
    out = df.select(F.col(key).alias("id")).join(joined.select("id", text.alias("text"), F.lit(1).alias("some")), "id", "left")
    return out.select(F.col("id").alias(key), F.when(F.col("some").isNull(), F.lit("")).otherwise(F.col("text")).alias("text"))
