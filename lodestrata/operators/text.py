"""Span, lexicon and grounding operators (J10, M1-M18, G2-G8, H1) on DataFrames."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.normalize import fold_text, tokens
from ..functions.policy import negated_in, split_section


def lexicon(spark: SparkSession, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """H1: (feature, alias, ord), first occurrences only; of the vocabulary's fixed size."""
    rows = [(f, a, i) for f, terms in aliases.items() for i, a in enumerate(dict.fromkeys(terms))]
    return spark.createDataFrame(rows, "feature string, alias string, ord int")


def merged_lexicon(parts: list[DataFrame]) -> DataFrame:
    """H1, M5: terms of several lexicons; the first lexicon, then the first place, that has a term owns it."""
    from functools import reduce

    ranked = reduce(DataFrame.unionByName, [p.withColumn("src", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy("alias").orderBy("src", "ord", "feature")
    return ranked.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def unambiguous(terms: DataFrame, term: str = "alias", owner: str = "feature") -> DataFrame:
    """Terms of one owner only."""
    n = terms.groupBy(term).agg(F.count_distinct(owner).alias("owners"))
    return terms.join(n.where("owners = 1").select(term), term, "left_semi")


def _trie(terms: list[str]) -> str:
    """Terms as a pattern that tries each first letter once; longer terms before their own beginnings."""
    heads: dict[str, list[str]] = {}
    for t in terms:
        heads.setdefault(t[:1], []).append(t[1:])
    out = []
    for head, rest in sorted(heads.items(), key=lambda kv: kv[0] == ""):
        out.append(re.escape(head).replace(r"\ ", " ") + (_trie(rest) if rest != [""] else "") if head else "")
    return out[0] if len(out) == 1 else "(?:" + "|".join(out) + ")"


def alternation(terms: tuple[str, ...] | list[str]) -> str:
    """A lexicon as one pattern, the longest of the terms that fit first, so that one pass over a text serves all; the
    set of first letters stands in front, as it rules out most places at once."""
    firsts = "".join(sorted({t[0] for t in terms}))
    return "(?U)(?=[" + re.escape(firsts) + r"])(?<!\w)" + _trie(sorted(set(terms))) + r"(?!\w)"


def mentions(df: DataFrame, key: str, text: str, aliases: dict[str, tuple[str, ...]], left: int = 0, right: int = 0) -> DataFrame:
    """(key, feature, alias, start, end): every non-overlapping mention of each finding, longest alias first;
    0-based places in the lower-cased text. One literal pattern a finding and one pass of it, so no join and no pattern
    per row: hits are marked, and the places follow from the lengths between the marks. With left or right, columns before
    and after have that many characters around each, cut where the mention is made, so no text travels with it."""
    low = df.select(F.col(key).alias("k"), F.translate(F.lower(text), "\x01\x02", "  ").alias("t")).where("t is not null")
    pairs = [F.struct(F.lit(f).alias("feature"), F.split(F.regexp_replace("t", alternation(a), "\x01$0\x02"), "\x01").alias("parts")) for f, a in aliases.items()]
    each = low.select("k", "t", F.explode(F.array(*pairs)).alias("e")).where("size(e.parts) > 1").select("k", "t", "e.*")
    cut = each.select("k", "t", "feature", F.length(F.element_at("parts", 1)).alias("first"), F.transform(F.slice("parts", 2, F.size("parts")), lambda p: F.split(p, "\x02")).alias("p"))
    starts = F.aggregate(
        "p",
        F.struct(F.col("first").alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, x: F.struct((s["at"] + F.length(x[0]) + F.length(x[1])).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
    )["starts"]
    found = F.arrays_zip(F.transform("p", lambda x: x[0]).alias("hits"), starts.alias("starts"))
    around: list[str] = []
    if left or right:
        around = ["m.before", "m.after"]
        low_of = lambda m: F.greatest(F.lit(1), m["starts"] + 1 - left)
        found = F.transform(
            found,
            lambda m: F.struct(
                m["hits"].alias("hits"), m["starts"].alias("starts"), F.col("t").substr(low_of(m), m["starts"] + 1 - low_of(m)).alias("before"),
                F.col("t").substr(m["starts"] + F.length(m["hits"]) + 1, F.lit(right)).alias("after"),
            ),
        )
    spans = cut.select("k", "feature", F.explode(found).alias("m"))
    return spans.select(F.col("k").alias(key), "feature", F.col("m.hits").alias("alias"), F.col("m.starts").alias("start"), (F.col("m.starts") + F.length("m.hits")).alias("end"), *around)


def present_outside(df: DataFrame, key: str, text: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, feature) with a mention outside the review of systems that no cue within 40 characters denies."""
    outside = df.select(F.col(key).alias("k"), split_section(F.col(text))[0].alias("outside"))
    m = mentions(outside, "k", "outside", aliases, 40, 40).where(~negated_in(F.col("before"), F.col("after")))
    return m.select(F.col("k").alias(key), "feature").distinct()


def leftmost_longest(spans: Column) -> Column:
    """M7: of structs (start, end) those that no earlier or, at one start, longer one overlaps."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    empty = F.slice(spans, 1, 0)
    return F.aggregate(ordered, empty, lambda kept, s: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept))


def greedy_cover(spans: Column) -> Column:
    """M6: longest spans first, each unless its start or end lies in one taken before."""
    ordered = F.array_sort(spans, lambda a, b: F.when((a["end"] - a["start"]) != (b["end"] - b["start"]), (b["end"] - b["start"]) - (a["end"] - a["start"])).otherwise(a["start"] - b["start"]))
    inside = lambda kept, p: F.exists(kept, lambda k: (k["start"] <= p) & (p < k["end"]))
    return F.aggregate(ordered, F.slice(spans, 1, 0), lambda kept, s: F.when(inside(kept, s["start"]) | inside(kept, s["end"] - 1), kept).otherwise(F.concat(kept, F.array(s))))


def sentence_chunks(df: DataFrame, key: str, text: str, size: int = 4, overlap: int = 1, least_sentence: int = 20, least_chunk: int = 50) -> DataFrame:
    """(key, chunk_no, chunk): runs of ``size`` sentences, each starting ``overlap`` before the last one's end."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.length(s) > least_sentence)
    df = df.select(F.col(key), parts.alias("s")).where("size(s) > 0")
    starts = F.sequence(F.lit(1), F.size("s"), F.lit(size - overlap))
    chunks = df.select(key, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("s", i, size), " "))).alias("chunk_no", "chunk"))
    return chunks.where(F.length("chunk") > least_chunk)


def ngrams(toks: Column, n: int) -> Column:
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, n), "\x01"))).otherwise(F.array().cast("array<string>"))


def clipped_precision(hyp: Column, ref: Column) -> Column:
    """Of the n-grams of hyp (with repeats) how many occur in ref, each at most as often as there."""
    count = lambda arr, g: F.size(F.filter(arr, lambda x: x == g))
    met = F.aggregate(F.array_distinct(hyp), F.lit(0), lambda acc, g: acc + F.least(count(hyp, g), count(ref, g)))
    return F.when(F.size(hyp) > 0, met / F.size(hyp)).otherwise(F.lit(0.0))


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row at a time."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        at = np.flatnonzero(b == x)
        if len(at):
            step = row[1:].copy()
            step[at] = np.maximum(step[at], row[at] + 1)
            row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


_TOKEN = re.compile(r"\w+|\S")


def _grams(toks: list[str], n: int) -> Counter:
    return Counter(zip(*(toks[i:] for i in range(n))))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("exact", "folded", "subsequence", "rouge_l", "bleu")
    for batch in batches:
        notes, quotes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out = {k: [None] * len(notes) for k in names}
        by_note: dict[str, list[int]] = {}
        for i, (note, quote) in enumerate(zip(notes, quotes)):
            if note and quote and len(quote.strip()) > 5:
                by_note.setdefault(note, []).append(i)
        for note, at in by_note.items():  # what a note has is made once a batch, whatever the number of its quotations
            folded, ref = " ".join(note.lower().translate(_FOLD).split()), _TOKEN.findall(note.lower())
            run = "\x01" + "\x01".join(ref) + "\x01"
            ids: dict[str, int] = {}
            b = np.array([ids.setdefault(t, len(ids)) for t in ref])
            counts = [_grams(ref, n) for n in range(1, 5)]
            for i in at:
                quote = quotes[i]
                hyp = _TOKEN.findall(quote.lower())
                out["exact"][i] = quote.strip() in note
                out["folded"][i] = " ".join(quote.lower().translate(_FOLD).split()) in folded
                out["subsequence"][i] = len(hyp) >= 4 and ("\x01" + "\x01".join(hyp) + "\x01") in run
                n = _lcs(np.array([ids.get(t, -1) for t in hyp]), b)
                out["rouge_l"][i] = 2 * n / (len(hyp) + len(ref)) if n else 0.0
                parts = []
                for k in range(1, min(4, len(hyp)) + 1):
                    h = _grams(hyp, k)
                    parts.append(sum(min(c, counts[k - 1][g]) for g, c in h.items()) / sum(h.values()))
                out["bleu"][i] = float(np.exp(np.mean(np.log(parts)))) if parts and min(parts) > 0 else 0.0
        columns = [pa.array(out[k], pa.bool_()) for k in names[:3]] + [pa.array(out[k], pa.float64()) for k in names[3:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["k", *names])


_FOLD = str.maketrans("“”‘’", "\"\"''")


def grounding(df: DataFrame, key: str, note: str, quote: str) -> DataFrame:
    """(key, exact, folded, subsequence, rouge_l, bleu, level) of a quotation against its note.

    Nulls and NOT_APPLICABLE where there is no note or no quotation of more than five characters. A kernel in Python,
    as the longest common subsequence is quadratic and interpreted slowly by nested folds; an Arrow batch at a time."""
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("k"), F.col(note).alias("n"), F.col(quote).alias("q"))
    out = narrow.mapInArrow(_scores, f"k {kind}, exact boolean, folded boolean, subsequence boolean, rouge_l double, bleu double")
    return out.withColumn("level", level(*(F.col(c) for c in ("exact", "folded", "subsequence", "rouge_l", "bleu")))).withColumnRenamed("k", key)


def level(exact: Column, folded: Column, subsequence: Column, rouge: Column, bleu: Column, bert: Column | None = None) -> Column:
    """The grounding level, by unrounded scores."""
    bert = F.lit(None).cast("double") if bert is None else bert
    at = lambda r, b, s: (rouge >= r) | (bleu >= b) | (bert >= s)
    return F.when(exact.isNull(), "NOT_APPLICABLE").when(exact | folded | subsequence, "STRONG").when(at(0.5, 0.3, 0.88), "MODERATE").when(at(0.2, 0.1, 0.85), "WEAK").otherwise("NONE")


def critique(bleu: Column) -> Column:
    """G10."""
    return F.when(bleu >= 0.15, "Correct").when(bleu >= 0.05, "Ambiguous").otherwise("Incorrect")


def contains_folded(note: Column, quote: Column) -> Column:
    """Exact or folded containment of a quotation with more than five characters that are no space."""
    long = F.length(F.regexp_replace(quote, r"\s", "")) > 5
    return F.coalesce(long & (F.contains(note, F.trim(quote)) | F.contains(fold_text(note), fold_text(quote))), F.lit(False))


def contains_tokens(note: Column, quote: Column, least: int = 4) -> Column:
    """The quotation's tokens, four or more, follow one another in the note."""
    sep = F.lit("\x01")
    wrap = lambda t: F.concat(sep, F.array_join(t, "\x01"), sep)
    q = tokens(quote)
    return F.coalesce((F.size(q) >= least) & F.contains(wrap(tokens(note)), wrap(q)), F.lit(False))


def _windows(ref: np.ndarray, hyp: np.ndarray) -> tuple[float, int]:
    """The best overlap, as a share of the union of both bags, of a run of 0.8 to 1.2 times the quotation's tokens, and
    where it begins; sliding counts of each of the quotation's tokens at once."""
    kinds, times = np.unique(hyp, return_counts=True)
    before = np.zeros((len(kinds), len(ref) + 1), np.int32)
    np.cumsum(ref[None, :] == kinds[:, None], axis=1, out=before[:, 1:])
    best, at = 0.0, -1
    for n in range(max(1, int(len(hyp) * 0.8)), min(len(ref), int(len(hyp) * 1.2)) + 1):
        both = np.minimum(before[:, n:] - before[:, :-n], times[:, None]).sum(axis=0)
        score = both / (n + len(hyp) - both)
        k = int(score.argmax())
        if score[k] > best:
            best, at = float(score[k]), k
    return best, at


def window_match(note: str | None, quote: str | None, least: float = 0.9, run: int = 4) -> tuple[int | None, float, int]:
    """(level, score, place) of a quotation of three characters or more: exact 1, folded 2, run of four tokens or more
    3, best window of three tokens or more 4; no level, with the best score, where there is none."""
    q = (quote or "").strip()
    if not note or len(q) < 3:
        return None, 0.0, -1
    if q in note:
        return 1, 1.0, note.index(q)
    folded, small = " ".join(note.lower().translate(_FOLD).split()), " ".join(q.lower().translate(_FOLD).split())
    if small in folded:
        return 2, 1.0, folded.index(small)
    ids: dict[str, int] = {}
    ref = np.array([ids.setdefault(t, len(ids)) for t in _TOKEN.findall(note.lower())])
    hyp = np.array([ids.setdefault(t, len(ids)) for t in _TOKEN.findall(q.lower())])
    if run <= len(hyp) <= len(ref):
        same = np.ones(len(ref) - len(hyp) + 1, bool)
        for i, t in enumerate(hyp):
            same &= ref[i : len(ref) - len(hyp) + 1 + i] == t
        if same.any():
            return 3, 1.0, int(same.argmax())
    best, at = _windows(ref, hyp) if len(hyp) >= 3 else (0.0, -1)
    return (4, best, at) if best >= least else (None, best, -1)


def window_grounding(df: DataFrame, key: str, note: str, quote: str, least: float = 0.9) -> DataFrame:
    """(key, level, score, place) of each quotation; Arrow batches, a kernel as no expression slides a window of counts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [window_match(n, q, least) for n, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            level_, score, place = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(level_, pa.int32()), pa.array(score, pa.float64()), pa.array(place, pa.int32())], names=["k", "level", "score", "place"])

    out = df.select(F.col(key).alias("k"), F.col(note).alias("n"), F.col(quote).alias("q")).mapInArrow(run, f"k {kind}, level int, score double, place int")
    return out.withColumnRenamed("k", key)


def retries(df: DataFrame, note: str, label: str, bleu: str, order: Column, most: int = 4) -> DataFrame:
    """The positives of a note whose grounding is not correct, at most ``most`` in the findings' order."""
    poor = df.where((F.col(label) == "Yes") & (critique(F.coalesce(F.col(bleu), F.lit(0.0))) != "Correct"))
    w = Window.partitionBy(note).orderBy(order)
    return poor.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most)
