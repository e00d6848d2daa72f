"""Near-duplicate records with small edits (problem 2): exact set-similarity self-join by vertical partitioning.

A record is its set of runs of three words (``size``); two records match if they share at least ``threshold`` of the
union. The order of all n-grams, rarest first, is global: by a count over the whole corpus, then by hash. It is cut into
fragments, overlaps are counted in each and summed per pair:

1. One pass writes each record's fingerprint (of its words in order) and counts its n-grams into 2**bits cells (n-grams are
   hashed to 64 bits, of which 56 are kept; a cell is their high bits; bits grows with the corpus up to MOST_BITS). The
   cell counts, one byte each on a log scale, are all that is shared with the tasks (a file in the shared folder that
   they map, deleted at the end). A cell counted once is an n-gram that no two records share. The counts only set the
   order, so no result depends on their precision; beyond MOST_BITS the order gets coarser, no more.
2. Each record's n-grams in that order. Records with fewer than ``threshold`` of their n-grams in cells counted twice
   cannot match and end here. Records of the same words have one fingerprint; postings are kept once a fingerprint, so
   hot copies cost one record.
3. The first fragment, the rarest: with sizes m <= n, matching needs an overlap of a = ceil(t / (1 + t) * (m + n)), so at
   least ``votes`` common n-grams lie in the first m - a + votes and n - a + votes places. Postings of those places are
   joined by n-gram and the partial overlaps summed per pair; pairs with fewer votes cannot match. An n-gram that more
   than HOT records have there (its cell tells) is cut into blocks of its records, and each two blocks meet under a key
   of their own, so that no task holds all its pairs.
4. The other fragments: for the pairs left, both records' segments are joined by fragment, overlaps are counted
   there and summed; the pair matches by its exact overlap.

Nothing is capped or sampled. Defined results: records of fewer than ``least`` words, null, empty and blank texts match
nothing; repeated rows match each other (pairs need different ids); an empty table gives an empty result; ids must be
unique and not null; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir, release
from .components import components

LEAST_BITS, MOST_BITS = 18, 28
BLOCK = 16
VOTES = 8
HOT = 2048
WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """64-bit hashes of words; bounded, as corpora have endless numbers."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


#: ASCII letters and digits in lower case, all else a space: splitting then finds the same words, sooner.
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


def words(text: str) -> list[str]:
    """Unbroken runs of letters and numbers, lower-cased one by one (a capital's lower form may hold a mark)."""
    if text.isascii():
        return text.translate(_ASCII).split()
    if "İ" in text or "Σ" in text:
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def grams(texts: list[str | None], size: int, least: int, hashes: _Hashes, marks: list[int] | None = None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of a batch, with repeats: the places of the texts that have any, where the
    runs of each begin (and the last ends), and the runs. Texts of fewer than ``least`` words have none. marks gets the
    fingerprints of their words."""
    at, lengths, flat = [], [], []
    for i, text in enumerate(texts):
        if text:
            found = words(text)
            n = len(found)
            if n >= least and n >= size:
                at.append(i)
                lengths.append(n)
                flat += found
                if marks is not None:
                    marks.append(xxhash.xxh3_64_intdigest(" ".join(found)) - (1 << 63))
    n = len(flat)
    if not n:
        return at, np.zeros(1, np.int64), np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, flat), np.uint64, n)
    out = h[: n - size + 1].copy()
    for k in range(1, size):
        out *= _M1 if k % 2 else _M2
        out += h[k : n - size + 1 + k]
    out ^= out >> np.uint64(29)
    out *= _M2
    ends = np.cumsum(lengths)
    inside = np.ones(n, bool)
    for k in range(1, size):
        inside[ends - k] = False  # a run must not reach into the next text
    return at, np.r_[0, np.cumsum(np.asarray(lengths) - size + 1)], out[inside[: len(out)]]


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to 63, then eight steps for each doubling."""
    c = np.asarray(counts, np.float64)
    return np.where(c < 64, c, np.minimum(255, 64 + 8 * np.log2(np.maximum(c, 64) / 64))).astype(np.uint8)


def _uncode(code: int) -> float:
    """The count that a byte stands for."""
    return code if code < 64 else 64 * 2 ** ((code - 64) / 8)


def _first_pass(kind: pa.DataType, size: int, least: int, bits: int):
    """Two kinds of rows: (id, print) of each record, and (part, block, offsets) for each block of cells that a batch of
    texts touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        names = ["id", "print", "part", "block", "offsets"]
        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else 0
            marks: list[int] = []
            at, _, g = grams(batch.column(1).to_pylist(), size, least, hashes, marks)
            if not len(g):
                continue
            n = len(at)
            no = lambda t, k: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(marks, pa.int64()), no(pa.int32(), n), no(pa.int32(), n), no(pa.binary(), n)], names=names)
            cell = np.sort((g >> np.uint64(64 - bits)).astype(np.uint32))
            block = cell >> BLOCK
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            low = (cell & ((1 << BLOCK) - 1)).astype(np.uint16)
            ends = np.r_[edges[1:], len(cell)]
            step = np.diff(low, prepend=low[:1])  # offsets as steps from the last: most are one byte long
            step[edges] = low[edges]
            blobs = [zlib.compress(step[i:j].tobytes(), 1) for i, j in zip(edges.tolist(), ends.tolist())]
            k = len(blobs)
            yield pa.RecordBatch.from_arrays([no(kind, k), no(pa.int64(), k), pa.array([part] * k, pa.int32()), pa.array(block[edges].astype(np.int32)), pa.array(blobs, pa.binary())], names=names)

    return run


def _add_offsets(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK, np.uint32)
    for blob in group.column("offsets"):
        total += np.bincount(np.cumsum(np.frombuffer(zlib.decompress(blob.as_py()), np.uint16), dtype=np.uint32), minlength=1 << BLOCK).astype(np.uint32)
    return pa.table({"block": group.column("block").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _add_counts(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK, np.uint64)
    for blob in group.column("counts"):
        total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
    return pa.table({"block": group.column("block").slice(0, 1), "codes": pa.array([zlib.compress(_code(total).tobytes(), 1)], pa.binary())})


def cell_counts(rows: DataFrame, parts: int, bits: int) -> np.ndarray:
    """The counts of the cells over the whole corpus, in one byte each; added up in two levels, so no task adds more
    than the batches of 64 parts, or one row of each 64 parts."""
    raw = rows.where("block is not null").select("part", "block", "offsets")
    if parts <= 64:  # one group a block: the second level would add nothing up
        done = raw.groupBy("block").applyInArrow(lambda g: _add_counts(_add_offsets(g)), "block int, codes binary")
    else:
        some = raw.withColumn("salt", (F.col("part") / 64).cast("int")).groupBy("block", "salt").applyInArrow(_add_offsets, "block int, counts binary")
        done = some.groupBy("block").applyInArrow(_add_counts, "block int, codes binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in done.collect():  # 2**(bits - BLOCK) rows
        out[r.block << BLOCK : (r.block + 1) << BLOCK] = np.frombuffer(zlib.decompress(r.codes), np.uint8)
    return out


_TOP = np.uint64(56)


def _ordered(texts: list[str | None], codes: np.ndarray, size: int, least: int, hashes: _Hashes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place, fingerprint, n-grams) of the texts that have any: the set in the global order, each as a count's code in the top byte
    and 56 bits of hash, so that the numbers themselves are in order."""
    marks: list[int] = []
    at, starts, g = grams(texts, size, least, hashes, marks)
    if not at:
        return
    code = codes[(g >> np.uint64(65 - int(codes.size).bit_length())).astype(np.int64)]
    key = (code.astype(np.uint64) << _TOP) | (g >> np.uint64(8))
    starts = starts.tolist()
    for a, z in zip(starts, starts[1:]):
        key[a:z].sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    fresh[starts[:-1]] = True
    ends = np.r_[0, np.cumsum(fresh)][starts].tolist()
    key = key[fresh]
    for i, mark, a, z in zip(at, marks, ends, ends[1:]):
        yield i, mark, key[a:z]


def _batch(names: tuple[str, ...], batch: pa.RecordBatch, at: list[int], columns: list[pa.Array], keys: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns, lists], names=list(names))


#: Bits of a posting's key: 46 of its n-gram's hash, its place in the global order (in 256ths of the record's size), its
#: role. The highest byte stays empty, so a posting next to another of its record compresses to little more than seven.
_GRAM, _PLACE, _ROLE = 46, 8, 2


def _meetings(gram: np.ndarray, code: int, mark: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, roles) under which a record meets the others that have a hot n-gram: its block with itself and with each
    other block. Role 2 meets all, 0 and 1 only one another."""
    blocks = int(_uncode(code) // hot) + 1
    own = mark % blocks
    other = np.arange(blocks, dtype=np.uint64)
    low, high = np.minimum(other, np.uint64(own)), np.maximum(other, np.uint64(own))
    key = (gram ^ (low * _M1 + high * _M2 + _M1)) * _M2
    return key ^ (key >> np.uint64(31)), np.where(other == own, 2, other > own).astype(np.uint64)


def _postings(codes_of, size: int, least: int, threshold: float, votes: int, hot: int):
    """(key, print, n): a record's rare n-grams; a task sends those of a fingerprint once."""
    twice, border = np.uint64(2) << _TOP, np.uint64(int(_code(np.asarray(hot)))) << _TOP
    room, above = np.uint64(_PLACE + _ROLE), np.uint64(64 - _GRAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, hashes, seen = codes_of(), _Hashes(), set()
        for batch in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            keys, marks, sizes, lengths = [], [], [], []
            for _, mark, g in _ordered(batch.column(1).to_pylist(), codes, size, least, hashes):
                n = len(g)
                once = int(np.searchsorted(g, twice))
                if n - once < threshold * n - 1e-9 or mark in seen:
                    continue
                seen.add(mark)
                end = min(n, n - ceil(threshold * n - 1e-9) + votes)
                part = g[once:end]
                place = (np.arange(once, end) * 256 // n).astype(np.uint64) << np.uint64(_ROLE)
                key = ((part << np.uint64(8)) >> above << room) | place | np.uint64(2)
                cold = int(np.searchsorted(part, border))
                if cold < len(part):
                    many = [key[:cold]]
                    for gram, at in zip(part[cold:], place[cold:]):
                        met, role = _meetings(gram << np.uint64(8), int(gram >> _TOP), mark, hot)
                        many.append((met >> above << room) | at | role)
                    key = np.concatenate(many)
                keys.append(key)
                marks.append(mark)
                sizes.append(n)
                lengths.append(len(key))
            if marks:
                columns = [np.concatenate(keys).view(np.int64), np.repeat(np.asarray(marks, np.int64), lengths), np.repeat(np.asarray(sizes, np.int32), lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "print", "n"])

    return run


FRAGMENTS = np.asarray([3, 9, 65], np.uint64) << _TOP


LEAST_FILTER, MOST_FILTER = 15, 28


def _bit(c: Column, bits: int) -> Column:
    """A record's place in the filter."""
    return F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))


def _filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of fixed size that all ids pass and most others do not."""
    out = np.zeros(1 << bits, bool)
    places = ids.select(_bit(F.col("id"), bits).alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("map"))
    for r in places.collect():  # 2**bits / 32768 rows at most; buckets hold 1 to 32768, and so on, so 0 has no place in them
        on = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r.map), np.uint8), bitorder="little"))
        out[(r.bucket - 1) * 32768 + on] = True
    return np.packbits(out, bitorder="little")


def _segments(codes_of, wanted, size: int, least: int):
    """(id, fragment, keys): the n-grams of a record that passes the filter in each fragment of the global order, but for
    those that no other record has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, hashes = codes_of(), _Hashes()
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((wanted.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            at, fragments, keys = [], [], []
            for i, _, g in _ordered(batch.column(1).to_pylist(), codes, size, least, hashes):
                g = g[int(np.searchsorted(g, np.uint64(2) << _TOP)) :]  # what no other record has is shared with none
                cuts = [0, *np.searchsorted(g, FRAGMENTS).tolist(), len(g)]
                for f, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        at.append(i)
                        fragments.append(f)
                        keys.append(g[a:b])
            if at:
                yield _batch(("id", "fragment", "keys"), batch, at, [pa.array(fragments, pa.int32())], keys)

    return run


class _Shared:
    """The cell codes in tasks: a file in the shared folder that they map, or a broadcast where it is no file system
    path; of a fixed size either way."""

    def __init__(self, spark: SparkSession, codes: np.ndarray, place: str) -> None:
        self.path = self.broadcast = None
        if place.startswith(("file:", "/")):
            self.path = "/" + place.removeprefix("file:").lstrip("/") + ".npy"
            np.save(self.path, codes)
        else:
            self.broadcast = spark.sparkContext.broadcast(zlib.compress(codes.tobytes(), 1))

    def __call__(self) -> np.ndarray:
        return np.load(self.path, mmap_mode="r") if self.path else np.frombuffer(zlib.decompress(self.broadcast.value), np.uint8)

    def drop(self) -> None:
        if self.path:
            os.unlink(self.path)
        else:
            self.broadcast.unpersist()


def _bits_for(n: int, least: int, most: int) -> int:
    return min(most, max(least, ceil(log2(max(n, 1)))))


def similar(df: DataFrame, key: str, text: str, threshold: float = 0.6, size: int = 3, least: int = 20, votes: int = VOTES, bits: int | None = None, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, class) of every record with a class, classes named by their least id; links
    (a, b, shared, n_a, n_b) between the classes whose sets match."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    base = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and length(text) > 0")
    if bits is None:  # about two cells an n-gram
        bits = _bits_for((base.agg(F.sum(F.length("text"))).first()[0] or 0) // 3, LEAST_BITS, MOST_BITS)
    kind = df.schema[key].dataType.simpleString()
    first = _first_pass(to_arrow_type(df.schema[key].dataType), size, least, bits)
    rows = cut(base.withColumn("part", F.spark_partition_id()).mapInArrow(first, f"id {kind}, print bigint, part int, block int, offsets binary"))
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    codes = _Shared(spark, cell_counts(rows, parts, bits), f"{ensure_checkpoint_dir(spark)}/neardup-{uuid.uuid4().hex}")
    try:
        return _similar(spark, base, rows.where("print is not null").select("id", "print"), codes, kind, threshold, size, least, votes, hot)
    finally:
        codes.drop()  # both passes that read it have run


def _similar(spark: SparkSession, base: DataFrame, records: DataFrame, codes: _Shared, kind: str, threshold: float, size: int, least: int, votes: int, hot: int) -> tuple[DataFrame, DataFrame]:
    release(spark)
    classes = records.groupBy("print").agg(F.min("id").alias("class"))
    members = records.join(classes, "print").select("id", "class")
    # partitioned before the copies are dropped: rows of a record that lie together compress, and tasks sent few copies
    packed = base.select("id", "text").mapInArrow(_postings(codes, size, least, threshold, votes, hot), "key bigint, print bigint, n int")
    gram = F.shiftright("key", _PLACE + _ROLE)
    once = packed.repartition(gram).select(gram.alias("gram"), "print", "n", F.col("key").bitwiseAND(F.lit((1 << (_PLACE + _ROLE)) - 1)).cast("int").alias("low"))
    once = once.groupBy("gram", "print", "n").agg(F.min("low").alias("low"))
    side = lambda c: once.select("gram", F.col("print").alias(c), F.col("n").alias(f"n_{c}"), F.shiftright("low", _ROLE).alias(f"p_{c}"), F.col("low").bitwiseAND(F.lit(3)).alias(f"r_{c}"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9)).cast("int")
    within = lambda c: F.col(f"p_{c}") * F.col(f"n_{c}") < 256 * (F.col(f"n_{c}") - need + votes)
    met = (
        side("a").join(side("b"), "gram")
        .where((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        .where((F.col("r_a") == 2) | (F.col("r_a") != F.col("r_b")))
        .where((F.col("n_a") >= need) & within("a") & within("b"))
        .groupBy("a", "b", (F.shiftleft(F.col("n_a").cast("bigint"), 32) + F.col("n_b")).alias("sizes"))
        .agg(F.count("*").alias("met"))
        .select("a", "b", F.shiftright("sizes", 32).cast("int").alias("n_a"), F.col("sizes").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n_b"), "met")
        .where(F.col("met") >= F.least(F.lit(votes), need))
    )
    named = lambda c: classes.select(F.col("print").alias(c), F.col("class").alias(f"class_{c}"))
    pairs = cut(met.join(named("a"), "a").join(named("b"), "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "n_a", "n_b"))
    release(spark)
    # no text is shuffled: a filter of bounded size picks the records to read again, and the join below is exact
    bits = _bits_for(32 * pairs.count(), LEAST_FILTER, MOST_FILTER)
    wanted = spark.sparkContext.broadcast(_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), bits))
    segments = cut(base.withColumn("bit", _bit(F.col("id"), bits)).mapInArrow(_segments(codes, wanted, size, least), f"id {kind}, fragment int, keys array<bigint>"))
    one = segments.select(F.col("id").alias("a"), "fragment", F.col("keys").alias("keys_a"))
    two = segments.select(F.col("id").alias("b"), "fragment", F.col("keys").alias("keys_b"))
    partial = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("keys_a", "keys_b")).alias("part"))
    links = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("shared")).where(F.col("shared") >= F.lit(threshold) * (F.col("n_a") + F.col("n_b") - F.col("shared")) - F.lit(1e-9))
    return members, links


def similar_pairs(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(row_a, row_b), row_a < row_b: every matching pair of rows, copies included, so its size is the square of the
    largest class of copies; ``similar_groups``, one row a record, is the form to use on a corpus."""
    members, links = similar(df, key, text, **options)
    m = lambda c, r: members.select(F.col("class").alias(c), F.col("id").alias(r))
    across = links.select("a", "b").join(m("a", "x"), "a").join(m("b", "y"), "b").select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))
    within = m("class", "row_a").join(m("class", "row_b"), "class").where("row_a < row_b").select("row_a", "row_b")
    return across.unionByName(within)


def similar_groups(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(key, class_id, links): the group of every record that matches another, directly or through others, and the
    number of classes of other texts that its own matches."""
    members, links = similar(df, key, text, **options)
    links, members = cut(links.select("a", "b")), cut(members)
    groups = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class").agg(F.count("*").alias("copies"))
    named = members.join(sizes, "class").join(degree, "class", "left").join(groups, F.col("class") == F.col("node"), "left")
    kept = named.where("copies > 1 or links > 0")
    return kept.select(F.col("id").alias(key), F.coalesce("component", "class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
