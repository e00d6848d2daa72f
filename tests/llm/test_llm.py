"""The training-data operators against brute force, exact round trips and hand-written cases."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import components, containers, encode, neardup, pieces, pii, sentences, splits, stuffing

TEXTS = [None, "", " \t\n", "word", "Ünïcode é a_b 12", "x" * 9000, "a. " * 5000, "​", "“open quote", "[" * 300, "日本語。中文！", "١٢٣"]


def frame(spark, texts, **extra):
    rows = [(i, t, *extra.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["id bigint", "text string", *(f"{k} string" for k in extra)]))


CLASH = {"part": "p", "n": "n", "size": "s", "print": "q", "row_key": "r", "start_pos": "z", "component": "c", "k": "k"}


# --- problem 1 ---------------------------------------------------------------------------------------------------


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(None, 1), (5, None), (7, 7)]
    df = spark.createDataFrame(edges, "a int, b int")
    assert {r.node: r.component for r in components.components(df).collect()} == brute_components(edges)
    assert components.components(df.limit(0)).count() == 0


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 20)
    edges = [(0, i) for i in range(1, 200)] + [(199, 300), (300, 301)] + [(400, 401)]
    df = spark.createDataFrame(edges, "a int, b int")
    assert {r.node: r.component for r in components.components(df).collect()} == brute_components(edges)


NOTES = [
    (0, " p1 ", "n1"), (1, "p1.0", "n2"), (2, "p2", "n2.0"), (3, "p3", "n3"), (4, "p4\t", "n3"), (5, None, "n3"), (6, "UNKNOWN", "n9"), (7, "N/A", "n9"), (8, None, None), (9, "-", "-"), (10, "p5", "UNKNOWN"),
    (11, "p6", "UNKNOWN"), (11, "p6", "UNKNOWN"), (12, "p2", "n4"), (13, "p7", "n4"),
]


def test_related_patients_and_splits(spark):
    df = spark.createDataFrame(NOTES, "_run_row_index bigint, PAT_ID string, NOTE_ID string")
    assert sorted(tuple(r) for r in splits.related_patients(df).collect()) == [("p1", "p2"), ("p1", "p7"), ("p2", "p7"), ("p3", "p4")]
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2), ("none", 0.0), ("null", None)], "split_name string, share double")
    got = splits.split(df, targets).collect()
    assert len(got) == len(NOTES) and {r.split_name for r in got} <= {"train", "test"}
    by = {r._run_row_index: r.component for r in got}
    assert by[0] == by[1] == by[2] == by[12] == by[13] and by[3] == by[4] == by[5] and by[6] == by[7] and by[8] != by[9] and by[10] != by[11]
    assert splits.split(df.limit(0), targets).count() == 0


def test_shares_in_spite_of_a_hot_patient(spark):
    df = spark.range(6000).select(F.col("id").alias("_run_row_index"), F.when(F.col("id") < 2000, "1").otherwise(F.concat(F.lit("q"), F.floor(F.col("id") / 3))).alias("PAT_ID"), F.lit(None).cast("string").alias("NOTE_ID"))
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split_name string, share double")
    n = {r.split_name: r["count"] / 6000 for r in splits.split(df, targets).groupBy("split_name").count().collect()}
    assert abs(n["train"] - 0.8) < 0.01 and abs(n["val"] - 0.1) < 0.01 and abs(n["test"] - 0.1) < 0.01


def test_every_component_is_hashed_by_one_rule(spark):
    """A larger patient moves only the components next to a border, not those of other splits."""
    rows = lambda big: spark.range(4000 + big).select(
        F.col("id").alias("_run_row_index"), F.when(F.col("id") >= 4000, "1").otherwise(F.concat(F.lit("q"), F.floor(F.col("id") / 2))).alias("PAT_ID"), F.lit(None).cast("string").alias("NOTE_ID")
    )
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split_name string, share double")
    one, two = ({r._run_row_index: r.split_name for r in splits.split(rows(n), targets).collect()} for n in (5, 60))
    assert sum(one[i] != two[i] for i in range(4000)) < 100


# --- problem 2 ---------------------------------------------------------------------------------------------------


def near_corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 70))) for _ in range(60)]
    for _ in range(80):
        t = rng.choice(texts).split()
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(0, 2)] = [rng.choice(vocabulary)] * rng.randrange(0, 3)
        texts.append(" ".join(t))
    return [*texts, *texts[:5], *TEXTS, "same " * 30, "Same " * 40]


def brute_near(texts, threshold=0.6, size=3, least=20):
    sets = {}
    for i, t in enumerate(texts):
        w = [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def test_near_duplicates(spark):
    texts = near_corpus()
    want = brute_near(texts)
    df = frame(spark, texts, **CLASH)
    got = [tuple(r) for r in neardup.similar_pairs(df, "id", "text", bits=18).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    groups = {r.id: r.class_id for r in neardup.similar_groups(df, "id", "text", bits=18).collect()}
    assert groups == brute_components(want)
    assert neardup.similar_pairs(df.limit(0), "id", "text", bits=18).count() == 0


def test_cell_counts_in_two_levels(spark):
    import pyarrow as pa

    df = frame(spark, near_corpus()).select("id", "text").repartition(70).withColumn("part", F.spark_partition_id())
    rows = df.mapInArrow(neardup._first_pass(pa.int64(), 3, 20, 18), "id bigint, print bigint, part int, block int, offsets binary").cache()
    one, two = (neardup.cell_counts(rows, n, 18) for n in (2, 70))
    assert (one == two).all() and one.max() > 2


def test_near_duplicates_with_hot_grams(spark):
    """One run of words in every record, and records of nothing but hot runs, in blocks of a few records."""
    rng = random.Random(8)
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = [" ".join(base + [f"v{rng.randrange(4)}" for _ in range(rng.randrange(1, 6))]) for _ in range(60)]
    texts += [" ".join(["one", "common", "run", "here", *(f"w{rng.randrange(40)}" for _ in range(30))]) for _ in range(60)]
    want = brute_near(texts)
    for hot in (3, 16):
        got = [tuple(r) for r in neardup.similar_pairs(frame(spark, texts), "id", "text", bits=18, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_nothing_stays_in_the_shared_folder(spark):
    import glob

    from lodestrata.session import ensure_checkpoint_dir

    place = ensure_checkpoint_dir(spark).removeprefix("file:")
    neardup.similar_groups(frame(spark, near_corpus()), "id", "text", bits=18).count()
    assert not glob.glob(f"{place}/neardup-*")


def test_near_duplicates_at_five_words(spark):
    texts = near_corpus()
    got = {tuple(r) for r in neardup.similar_pairs(frame(spark, texts), "id", "text", threshold=0.8, size=5, bits=18).collect()}
    assert got == brute_near(texts, 0.8, 5)


def test_filter_holds_every_place(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_bit", lambda c, bits: c)
    bits = [0, 1, 7, 32767, 32768, 32769, 65536, (1 << 20) - 1]
    got = neardup._filter(spark.createDataFrame([(b,) for b in bits], "id bigint"), 20)
    assert np.flatnonzero(np.unpackbits(got, bitorder="little")).tolist() == bits


# --- problem 4 ---------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence ends. ", "\n", "\n\n", "- item\n", "HEADING:\n", "x" * 70, "。", "é", " "]), max_size=80).map("".join), st.integers(20, 120))
def test_pieces_cover(text, limit):
    overlap = limit // 5
    got = pieces.pieces(text, limit, overlap)
    end = 0
    for k, (a, z, _) in enumerate(got):
        assert z - a <= limit and end < z and a <= end and end - a <= overlap and (k == 0 or a > got[k - 1][0])
        end = z
    assert end == len(text)
    whole = "".join(text[max(a, got[k - 1][1] if k else 0) : z] for k, (a, z, _) in enumerate(got))
    assert whole == text
    if len(text) > limit:
        run = re.search(rf"[^\s{pieces.MARKS}]{{{limit + 1}}}", text)
        assert pieces.cut_kind(text, limit, overlap) == ("forced" if run else "natural")


def test_pieces_follow_the_structure():
    sent = "This is one more sentence of some length here. "
    text = "HEADING:\n" + (sent * 90)[:3800].rstrip() + ".\n" + "y" * 3900
    got = pieces.pieces(text)
    assert [(z, k) for _, z, k in got] == [(len(text) - 3900, "line"), (len(text), "end")]
    a = "# One\n\n" + sent * 60 + "\n\n## Part\n\n" + sent * 30 + "\n\n# Two\n\n" + sent * 60 + "\n\n- item\n  - inner\n- item\n"
    parts = pieces.packed(a)[0]
    assert [a[s:].split("\n")[0] for s, _, _ in parts] == ["# One", "## Part", "# Two"] and [k for _, _, k in parts] == ["heading", "heading", "end"]
    for s, z, _ in parts:
        assert not pieces.heading_level(a[s:z].strip().split("\n")[-1])
    assert [k for _, k in pieces.boundaries("- a\n  - b\n  - c\n- d\nText")] == [pieces.ITEM + 2, pieces.ITEM + 2, pieces.ITEM + 1, pieces.BLOCK]


def test_pieces_kinds(spark):
    t = ["short", "w " * 3000, "x" * 4001, "x" * 3999 + "." + "x" * 3999, "a" * 4000 + " " + "b" * 4000, None, ""]
    got = {r.id: r.cut_kind for r in pieces.oversized(frame(spark, t, **CLASH), "id", "text").collect()}
    assert got == {1: "natural", 2: "forced", 3: "natural", 4: "natural"}
    cuts = [r.piece_cut for r in pieces.split_pieces(frame(spark, t), "id", "text").where("id in (1, 3, 4)").collect()]
    assert "forced" not in cuts


def test_long_white_space_is_oversized(spark):
    texts = [" " * 5000, "a" + " " * 5000, "a " * 10 + "\n" * 4000, "x" * 4001, "x" * 4000, " " * 4000]
    got = {r.id: r.cut_kind for r in pieces.oversized(frame(spark, texts, **CLASH), "id", "text").collect()}
    assert got == {0: "natural", 1: "natural", 2: "natural", 3: "forced"}
    assert all(r.cut_kind for r in pieces.split_pieces(frame(spark, texts), "id", "text").collect())


# --- problem 5 ---------------------------------------------------------------------------------------------------

SENTENCES = [
    ("He lost 3.5 kg. Dr. A. Smith saw him at 5 p.m. on Jan. 3, 2020. Fine.", ["He lost 3.5 kg.", "Dr. A. Smith saw him at 5 p.m. on Jan. 3, 2020.", "Fine."]),
    ('She asked, "Will it stop?" and I said it might. Next.', ['She asked, "Will it stop?" and I said it might.', "Next."]),
    ('"I felt ill. It went away," the patient said.', ['"I felt ill. It went away," the patient said.']),
    ("(All was well.) He left.", ["(All was well.)", "He left."]),
    ("HPI:\nThe pain\ncomes and goes. 2 tabs daily\nDenies fever", ["HPI:", "The pain\ncomes and goes.", "2 tabs daily", "Denies fever"]),
    ("Plan: rest\n- one thing. two\n2) other\n[+] third", ["Plan: rest", "- one thing. two", "2) other", "[+] third"]),
    ("否认便血。“好了。”患者如是说。是否停用？", ["否认便血。", "“好了。”患者如是说。", "是否停用？"]),
    ("ไม่มีไข้ ติดต่อ02 123 4567ก่อน\nปวดท้อง", ["ไม่มีไข้", "ติดต่อ02 123 4567ก่อน", "ปวดท้อง"]),
    ("डॉ. राम आए। दवा 5 मि.ग्रा. लें।", ["डॉ. राम आए।", "दवा 5 मि.ग्रा. लें।"]),
    ("هل نوقف الدواء؟ نعم.", ["هل نوقف الدواء؟", "نعم."]),
    ("Open “quote without end. Second sentence.", ["Open “quote without end.", "Second sentence."]),
    ("a" * 50 + "\nText.", ["a" * 50, "Text."]),
    ("He said (one [two “three «four 「five 『six open. Then) it went on. Next.", ["He said (one [two “three «four 「five 『six open. Then) it went on.", "Next."]),
    ("See " + "x" * 60 + ".txt and a" + "." * 0 + "b" * 40 + "@x.example. It went on.", ["See " + "x" * 60 + ".txt and a" + "b" * 40 + "@x.example.", "It went on."]),
    ("- one\n  goes on\n  - two\n    and on\n- three\nText here.", ["- one\n  goes on", "- two\n    and on", "- three", "Text here."]),
    ("Cf. fig. 3 and Prof. Li, approx. 4 p.m. by Vers.-Nr. 7. Done.", ["Cf. fig. 3 and Prof. Li, approx. 4 p.m. by Vers.-Nr. 7.", "Done."]),
]


@pytest.mark.parametrize("text, want", SENTENCES)
def test_sentences(text, want):
    assert [text[a:z] for a, z in sentences.sentences(text)] == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB1. !?\n\"“”()。「」ก-", max_size=80))
def test_sentences_hold_all_characters(text):
    spans = sentences.sentences(text)
    assert all(a < z for a, z in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    inside = "".join(text[a:z] for a, z in spans)
    assert "".join(inside.split()) == "".join(text.split())


def test_sentences_in_linear_time():
    import time

    for text in ("a." * 100_000, "(" * 50_000 + ")" * 50_000, "([{" * 30_000 + "”" * 60_000, "[1] " * 50_000):
        began = time.time()
        sentences.sentences(text)
        assert time.time() - began < 8


def test_sentence_spans_of_odd_texts(spark):
    got = sentences.sentence_spans(frame(spark, TEXTS, **CLASH), "id", "text")
    assert {r.id for r in got.collect()} >= {3, 4, 5, 6} and got.columns == ["id", "start_pos", "end_pos"]


# --- problem 6 ---------------------------------------------------------------------------------------------------

MENTIONS = [
    ("Dr. Ana de la Cruz started it; call 555-123-4567 ext. 12.", [("Ana de la Cruz", "name"), ("555-123-4567 ext. 12", "phone")]),
    ("Mail a.b+c (at) x-y.example now", [("a.b+c (at) x-y.example", "email")]), ("Two tabs @ 11.27 h", []),
    ("Patient SMITH, JO (MRN 00123456) was seen", [("SMITH, JO", "name"), ("00123456", "id_number")]), ("Lot 7880-0083-28, order no. H-90-640086", []),
    ("Lives at 12-B Elm Court, Unit 7 with", [("12-B Elm Court, Unit 7", "address")]), ("Frau Kern, wohnhaft Am Berg 4, bittet", [("Kern", "name"), ("Am Berg 4", "address")]),
    ("担当は田中 太郎医師、電話０５５５/１２７７０４５", [("田中 太郎", "name"), ("０５５５/１２７７０４５", "phone")]), ("The Murphy sign at St. Luke's", []), ("M. Jo Bo habite 5 bis av. Foch, 75001 Lutz ;", [("Jo Bo", "name"), ("5 bis av. Foch, 75001 Lutz", "address")]),
]


@pytest.mark.parametrize("text, want", MENTIONS)
def test_mentions(text, want):
    assert [(text[a:z], k) for a, z, k in pii.mentions(text)] == want


def test_mentions_in_odd_places():
    """Long local parts, capitals whose lower form is longer, names without a title, numbers with check digits."""
    say = lambda text: [(text[a:z], k) for a, z, k in pii.mentions(text)]
    assert say("Mail " + "a" * 300 + "@x.example now") == [("a" * 300 + "@x.example", "email")]
    text = "DR. SMITH wrote. Signed by Anna Kern. MRN 00123456"
    assert say("İ " + text) == say(text) and len(say(text)) == 3
    assert say("Please call John Miller tomorrow. Emily Stone visited with Mark Reed.") == [("John Miller", "name"), ("Emily Stone", "name"), ("Mark Reed", "name")]
    assert say("Seen by Jo Bo. Later Jo Bo left for Mercy General Hospital.") == [("Jo Bo", "name")] * 2
    assert say("000-00-0000 and 0000-0000-0000-0000") == [] and say("seen at Mayo Clinic, call Mercy General Hospital") == []
    assert say("Card 4111 1111 1111 1111, not 4111 1111 1111 1112; DE89 3704 0044 0532 0130 00") == [("4111 1111 1111 1111", "id_number"), ("DE89 3704 0044 0532 0130 00", "id_number")]


def test_linked_pseudonyms():
    core = lambda v: re.sub(r"\D", "", pii.permute_phone(v, b"k").split(" ext")[0])[-10:]
    assert len({core(v) for v in ("555-123-4567", "+1 555 123 4567", "(555) 123-4567 ext. 12", "0555/1234567")}) == 1
    assert pii.permute_phone(pii.permute_phone("+1 555 123 4567 ext. 12", b"k"), b"k", back=True) == "+1 555 123 4567 ext. 12"
    new = pii.permute_format("12345678Z", b"k")
    assert new[-1] == pii.check_letter(new[:-1]) and pii.permute_format(new, b"k", back=True) == "12345678Z"
    assert len(pii.pseudonym("Jo Bo", "name", b"k")) == len("[NAME:]") + 32 and pii.pseudonym("JO  BO", "name", b"k") == pii.pseudonym("Jo Bo", "name", b"k")
    assert "2020" in pii.masked("Seen 2020-01-02.", b"k", dates=False)


def test_cut_quotation():
    assert [(k, a) for a, _, k in pii.mentions("Glynorth, who prefers tea", quote=True)] == [("name", 0)]
    assert pii.mentions("Glynorth, who prefers tea") == []


@settings(max_examples=100, deadline=None)
@given(st.from_regex(r"\A[A-Z]?[0-9]{1,4}[- ]?[0-9]{0,4}[A-Z]?\Z"), st.binary(min_size=1, max_size=16))
def test_format_is_kept_and_turned_back(value, key):
    new = pii.permute_format(value, key)
    assert len(new) == len(value) and [c.isdigit() for c in new] == [c.isdigit() for c in value] and pii.permute_format(new, key, back=True) == value


def test_feistel_is_a_permutation():
    assert len({pii.feistel(f"{i:03}", b"k") for i in range(1000)}) == 1000
    from datetime import date

    day = date(2001, 2, 3)
    assert pii.permute_day(pii.permute_day(day, b"k"), b"k", back=True) == day
    assert pii.permute_dates("on 2001-02-03 and 31/31/2001", b"k")[:3] == "on " and "31/31/2001" in pii.permute_dates("on 31/31/2001", b"k")


def test_masked(spark):
    texts = ["Call 555-123-4567 or (555) 123-4567.", None, "", "nothing"]
    got = {r.row_key: r.masked for r in pii.pii_masked(frame(spark, texts, **CLASH), "id", "text", b"k").collect()}
    assert got[1] is None and got[2] == "" and got[3] == "nothing"
    codes = re.findall(r"\[PHONE:([^\]]+)\]", got[0])
    assert len({re.sub(r"\D", "", c) for c in codes}) == 1 and "123" not in got[0].replace(codes[0], "").replace(codes[1], "")
    assert pii.pii_spans(frame(spark, TEXTS, **CLASH), "id", "text").count() == 0


# --- problems 7 and 8 --------------------------------------------------------------------------------------------


def test_blocks_and_repeated_ids(spark, monkeypatch):
    words = [f"w{i % 700} the" for i in range(3000)]
    df = spark.createDataFrame([("a", " ".join(words)), ("a", "the the"), (None, "x the"), ("b", None)], "key string, text string").coalesce(1)
    enc = encode.encoding(encode.tokenizer_path())
    want = sorted((str(k), enc.encode_ordinary(t or "")) for k, t in [("a", " ".join(words)), ("a", "the the"), (None, "x the"), ("b", None)])
    assert sorted((str(r.key), list(r.ids)) for r in encode.encode(df, "key", "text").collect()) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(i) for i in range(128)], max_size=60))
def test_both_cutters_agree(text):
    plain, full = encode.cutters()
    assert plain(text) == full(text) and "".join(plain(text)) == text


def test_encode_and_decode(spark):
    rng = random.Random(1)
    texts = [*TEXTS, "<|endoftext|> is text", "a " * 6000, *("".join(rng.choice("ab é日 \n1") for _ in range(40)) for _ in range(30))]
    df = frame(spark, texts, **CLASH)
    ids = encode.encode(df, "id", "text")
    got = {r.id: list(r.ids) for r in ids.collect()}
    enc = encode.encoding(encode.tokenizer_path())
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.id: r.n_tokens for r in encode.sizes(df, "id", "text").collect()} == {i: len(x) for i, x in got.items()}
    back = {r.id: r.text for r in encode.decode(ids, "id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode.encode(df.limit(0), "id", "text").count() == 0
    assert encode.decode(spark.createDataFrame([(1, [50256])], "id int, ids array<int>"), "id", "ids").first().text is None


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_holds_every_item(sizes):
    counts = np.bincount(sizes, minlength=41)
    groups = containers.plan(counts, 40)
    used = np.zeros(41, int)
    for need, times in groups:
        assert sum(s * m for s, m in need.items()) <= 40 and times > 0
        for s, m in need.items():
            used[s] += m * times
    assert (used == counts).all()


def test_pack(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(1, 150) for _ in range(400)] + [7] * 300 + [0, 100, 100, 250, 301]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(9999, None, "x"), (3, sizes[3], "x")], "id bigint, tokens int, size string")
    got = containers.pack(df, "id", "tokens", capacity=100).collect()
    total, load = {}, {}
    for r in got:
        total[r.id] = total.get(r.id, 0) + r["size"]
        load[r.container] = load.get(r.container, 0) + r["size"]
    assert max(load.values()) <= 100 and total == {i: s * (2 if i == 3 else 1) for i, s in enumerate(sizes) if s}
    assert len(load) <= -(-sum(load.values()) // 100) + 2
    assert containers.pack(df.limit(0), "id", "tokens").count() == 0


# --- problem 9 ---------------------------------------------------------------------------------------------------

PROSE = "The patient was seen on Monday. She reports mild pain after lunch, which went away by evening. No fever was noted, and the family will call again if it comes back. "
SPAM = [
    ", ".join(f"{a} zolumab {b}mg {c}" for a, b, c in zip(["Buy", "Get", "Cheap", "Order"] * 4, [5, 10, 20] * 6, ["online", "no Rx", "overnight"] * 6)), "#sale #pills #zol #mild #deal #cheap #zol #new #sale #best #brief",
    "buy zol http://a.example/buyzol\norder pax www.b.test/order_pax\nbuy zol c.example/best-zol?id=4\norder pax http://d.example/buyzol\nbuy zol www.e.test/zol", "激安通販、送料無料、即日発送、激安通販、激安通販12、送料無料、即日発送、送料無料、激安通販、即日発送",
    "激安通販送料無料即日発送激安通販激安通販12送料無料即日発送送料無料激安通販即日発送" * 2,
]
HONEST = [
    PROSE, "References\n1. Ho DN. Pain after meals. J Med. 2024;6:2. www.a.test/crp\n2. Li BN. Fever in spring. J Ther. 2020;4:3. https://b.example/alt\n3. Bo TS. Sleep and age. J Clin. 2011;2:1. http://c.example/x",
    "Review of systems\nPain: no\nFever: yes\nSleep: denies\nPain: no\nNausea: yes\nCough: no\nFever: no\nRash: denies", "Current medications:\nzol 5 mg q.d.\npax 10 mcg b.i.d.\nlax 7 mg t.i.d.\nmox 2 tabs q.h.s.\nfen 9 mg p.r.n.",
]


def test_stuffed_pages(spark):
    texts = [*SPAM, *HONEST, PROSE * 4 + SPAM[0], PROSE[:60] + SPAM[0], *TEXTS]
    got = {r.id for r in stuffing.stuffed(frame(spark, texts, **CLASH), "id", "text").collect()}
    n = len(SPAM) + len(HONEST)
    assert got - set(range(n + 2, len(texts))) == {*range(len(SPAM)), n + 1}
    assert stuffing.stuffed(frame(spark, texts).limit(0), "id", "text").count() == 0


def test_markup_and_padding():
    links = [f'<a href="https://www.s{i}.example/{w}/buy{p}">best {q}</a>' for i, (w, p, q) in enumerate(zip("abcdef", "zol pax lax mox fen dul".split(), "pax zol mox fen dul lax".split()))]
    spam = ["\n\n".join(links), (" " * 60).join(["#zol", "#pax", "#lax", "#mox"])]
    honest = ["See <a href='https://a.example/zol'>the leaflet</a> before you take it, and call if it hurts.", "| a |" + " " * 400 + "| b |"]
    at, share = stuffing.stuffed_shares([*spam, *honest])
    assert {i for i, x in zip(at, share) if x > stuffing.SHARE} == {0, 1}


def test_short_stuffed_pages():
    links = ["http://a.example/zol", "www.b.test/pax?id=3", "c.example/5/lax", "http://d.example/mox.html", "www.e.test/fen", "f.example/dul", "http://g.example/rin", "www.h.test/kat"]
    spam = ["\n".join(links[:n]) for n in (2, 3, 4, 8)] + ["#zol #pax #lax", "buy " + " ".join(links[:3])]
    honest = [links[0], "#zol", "zol", "Takes zol 5 mg and pax.", f"Seen on Monday, see {links[0]} for the leaflet.", f"The leaflet is at {links[0]} and the form to sign is at {links[1]} for you."]
    at, share = stuffing.stuffed_shares([*spam, *honest, *TEXTS])
    assert {i for i, x in zip(at, share) if x > stuffing.SHARE} == set(range(len(spam)))


def test_lists_without_function_words_and_long_cycles():
    rng = random.Random(3)
    names = list(dict.fromkeys("".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(90)))
    spam = [", ".join(names[:20]), " | ".join(f"{a} {b}" for a, b in zip(names[::2], names[1::2])), " ".join(names[:40]), "\n".join(names[:40] * 4)]
    honest = [
        "Medications: " + ", ".join(f"{a} {i} mg" for i, a in enumerate(names[:20])), "\n".join(f"{a}: {b}" for a, b in zip(names[:20], names[20:40])), "\n".join(names[:30]),
        "\n".join(f"{a}\t{i}.4\t{i}-{i + 9}" for i, a in enumerate(names[:30])) * 3, (" ".join(f"{a} of the {b}" for a, b in zip(names[:40], names[40:80])) + ".\n") * 4,
        "She denies " + ", ".join(names[:5]) + ". " + PROSE, PROSE * 5,
    ]
    at, share = stuffing.stuffed_shares([*spam, *honest])
    assert {i for i, x in zip(at, share) if x > stuffing.SHARE} == set(range(len(spam)))


# --- queries -----------------------------------------------------------------------------------------------------


def test_queries_against_duckdb(spark, data):
    import glob

    import duckdb

    from lodestrata.llm import queries

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, data)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall()), name
