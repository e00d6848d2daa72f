"""Micro-cases of the normalisers, the assertion policy, grounding, the loop and the statistics."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import normalize as N
from lodestrata.functions import policy as P
from lodestrata.functions import vocabulary as V
from lodestrata.operators import contracts, loop, parsing, retrieval, stats
from lodestrata.operators import text as T
from lodestrata.sources import io


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(column.alias("r")).first().r


@pytest.mark.parametrize("raw, want", [(" 12.0\t", "12"), ("12", "12"), ("A1.0", "A1"), (None, None)])
def test_normalize_id(spark, raw, want):
    assert one(spark, N.normalize_id(F.col("c")), c=raw) == want


@pytest.mark.parametrize("raw, want", [("YES ", "Yes"), ("absent", "No"), ("maybe", None), (None, None)])
def test_label(spark, raw, want):
    assert one(spark, N.label(F.col("c")), c=raw) == want


def test_tri_state_and_numbers(spark):
    assert one(spark, N.tri_bool(F.col("c")), c="False") is False
    assert one(spark, N.tri_bool(F.col("c")), c="false?") is None
    assert one(spark, N.safe_bool(F.col("c")), c="false") is False
    assert one(spark, N.first_number(F.col("c")), c="about -3.5 mg of 7") == -3.5
    assert one(spark, N.first_number(F.col("c")), c="none") is None
    assert one(spark, N.confidence(F.col("c")), c="6") is None


def test_normalize_text_decomposes(spark):
    assert one(spark, N.normalize_text(F.col("c")), c=" “Ｆｉｎｅ”  Day ") == '"fine" day'


@pytest.mark.parametrize(
    "text, term, want",
    [
        ("denies diarrhea", "diarrhea", "NEGATED"), ("no fever but diarrhea", "diarrhea", "AFFIRMED"), ("h/o constipation", "constipation", "HISTORICAL"),
        ("history of pain, no history of melena", "melena", "NEGATED"), ("will screen for melena", "melena", "PLANNED"), ("possible melena", "melena", "HYPOTHETICAL"),
        ("melena denied today", "melena", "NEGATED"), ("no pain. melena", "melena", "AFFIRMED"),
    ],
)
def test_assertion_class(spark, text, term, want):
    at = text.index(term) + 1
    assert one(spark, P.assertion_class(F.col("c"), F.lit(at), F.lit(at + len(term))), c=text) == want


@pytest.mark.parametrize(
    "quote, want",
    [(None, "UNKNOWN"), ("headache", "NO_TARGET_FOUND"), ("has melena", "AFFIRMED"), ("without melena", "NEGATED"), ("no evidence of melena", "POSSIBLE_DOUBLE_NEGATION"), ("melena resolved", "NEGATED")],
)
def test_quote_negation(spark, quote, want):
    df = spark.createDataFrame([(quote, "Rectal bleeding")], "q string, f string")
    assert df.select(P.quote_negation(F.col("q"), F.col("f"), V.ALIASES).alias("r")).first().r == want


def test_context_failures(spark):
    fails = lambda f, a, q: one(spark, P.context_failures(F.lit(f), F.lit(a), F.col("q")), q=q)
    assert fails("Rectal bleeding", "occult blood", "occult blood test ordered") == ["TEST_OR_ORDER_ONLY"]
    assert fails("Rectal bleeding", "occult blood", "occult blood ordered, positive") == []
    assert fails("Weight loss", "weight loss", "encourage weight loss") == ["ADVICE_OR_PREVENTION_CONTEXT", "WEIGHT_LOSS_GOAL_OR_PURPOSE"]
    assert fails("Constipation", "straining", "straining to hear") == ["STRAINING_NOT_BOWEL_CONTEXT"]
    assert fails("Diarrhea", "diarrhea", "diarrhea: none") == ["EXPLICIT_NONE_CONTEXT"]
    assert fails("Diarrhea", "diarrhea", "  ") == ["EMPTY_CANDIDATE"]


def test_mentions_and_covers(spark):
    df = spark.createDataFrame([(1, "Colicky abdominal pain; pelvic pain and Melena."), (2, "unmelenaed"), (3, None)], "k int, t string")
    got = [(r.k, r.feature, r.alias, r.start, r.end) for r in T.mentions(df, "k", "t", V.ALIASES).collect()]
    assert sorted(got) == [(1, "Abdominal pain", "colicky abdominal pain", 0, 22), (1, "Abdominal pain", "pelvic pain", 24, 35), (1, "Rectal bleeding", "melena", 40, 46)]
    s = spark.sql("select array(named_struct('start', 8, 'end', 22), named_struct('start', 0, 'end', 10), named_struct('start', 0, 'end', 5), named_struct('start', 30, 'end', 31)) s")
    assert [tuple(x) for x in s.select(T.leftmost_longest(F.col("s")).alias("r")).first().r] == [(0, 10), (30, 31)]
    assert [tuple(x) for x in s.select(T.greedy_cover(F.col("s")).alias("r")).first().r] == [(8, 22), (0, 5), (30, 31)]


def test_grounding(spark):
    note = "Patient reports mild abdominal pain after meals, no fever."
    quotes = [("mild abdominal pain", "STRONG"), ("MILD  abdominal pain", "STRONG"), ("short", "NOT_APPLICABLE"), (None, "NOT_APPLICABLE"), ("abdominal pain mild after meals often", "WEAK"), ("zzz yyy xxx www", "NONE")]
    df = spark.createDataFrame([(i, note, q) for i, (q, _) in enumerate(quotes)], "k int, n string, q string")
    got = {r.k: r for r in T.grounding(df, "k", "n", "q").collect()}
    assert [got[i].level for i in range(len(quotes))] == [w for _, w in quotes]
    assert got[0].bleu == 1.0 and 0 < got[4].rouge_l < 1 and got[5].bleu == 0.0


def test_window_match():
    assert T.window_match("a b c d e f", "b c d")[0] == 1
    assert T.window_match("A  b c", "a b C")[0] == 2
    assert T.window_match("one two, three four five six seven eight nine ten eleven", "two three, four five six seven eight nine ten eleven")[0] == 4
    assert T.window_match("aa bb", "zz yy") == (None, 0.0, -1) and T.window_match(None, "x") == (None, 0.0, -1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=20), st.lists(st.sampled_from("abcd"), min_size=3, max_size=8))
def test_windows_against_brute_force(ref, hyp):
    from collections import Counter

    best = (0.0, -1)
    for n in range(max(1, int(len(hyp) * 0.8)), min(len(ref), int(len(hyp) * 1.2)) + 1):
        for i in range(len(ref) - n + 1):
            a, b = Counter(hyp), Counter(ref[i : i + n])
            score = sum((a & b).values()) / sum((a | b).values())
            if score > best[0]:
                best = (score, i)
    got = T._windows(np.array([ord(c) for c in ref]), np.array([ord(c) for c in hyp]))
    assert abs(got[0] - best[0]) < 1e-12 and got[1] == best[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), min_size=1, max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert T._lcs(np.array(a), np.array(b)) == table[-1][-1]


def rounds(*r):
    return F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).cast("string").alias("verdict"), F.lit(c).alias("error")) for a, b, c in r)) if r else F.array().cast("array<struct<label:string,verdict:string,error:boolean>>")


@pytest.mark.parametrize(
    "initial, made, want",
    [
        ("VERIFIED", [], ("VERIFIED", "Yes", 0, 0)), ("ODD", [], ("INVALID_INITIAL_VERIFIER_STATE", "Yes", 0, 0)), ("REFINE", [("Yes", None, False)], ("LABEL_STABLE", "Yes", 1, 0)),
        ("REFINE", [("No", "VERIFIED", False)], ("VERIFIED", "No", 1, 1)), ("REFINE", [("No", "REFINE", True)], ("REFINEMENT_ERROR", "Yes", 1, 0)),
        ("REFINE", [("No", "WHAT", False)], ("INVALID_REVERIFICATION_STATE", "No", 1, 1)),
        ("REFINE", [(x, "REFINE", False) for x in ("No", "Yes", "No", "Yes", "No")], ("MAX_ROUNDS_LABEL_OSCILLATION", "No", 5, 5)),
        ("REFINE", [*((x, "REFINE", False) for x in ("No", "Yes", "No", "Yes")), ("No", "VERIFIED", False)], ("MAX_ROUNDS_FINAL_VERIFIED", "No", 5, 5)),
        ("REFINE", [*((x, "REFINE", False) for x in ("No", "Yes", "No", "Yes")), ("No", None, False)], ("MAX_ROUNDS_FINAL_VERIFICATION_ERROR", "No", 5, 5)),
    ],
)
def test_loop(spark, initial, made, want):
    s = spark.range(1).select(loop.fold_rounds(F.lit(initial), F.lit("Yes"), rounds(*made)).alias("s")).first().s
    assert (s.exit_reason, s.label, s.rounds, s.flips) == want


def test_live_loop_is_the_fold(spark):
    claims = spark.createDataFrame([(1, "Yes", "REFINE"), (2, "Yes", "VERIFIED"), (3, "No", "REFINE")], "k int, label string, verdict string")
    answers = spark.createDataFrame([(1, n, x, "REFINE", False) for n, x in enumerate(("No", "Yes", "No", "Yes", "No"), 1)] + [(3, 1, "Yes", "REFINE", False), (3, 2, "Yes", "REFINE", False)], "k int, round int, new_label string, new_verdict string, error boolean")
    got = {r.k: (r.exit_reason, r.label, r.rounds) for r in loop.run_live(claims, loop.TableBackend(answers, ["k", "round"])).collect()}
    assert got == {1: ("MAX_ROUNDS_LABEL_OSCILLATION", "No", 5), 2: ("VERIFIED", "Yes", 0), 3: ("LABEL_STABLE", "Yes", 2)}


def test_statistics(spark):
    p = lambda b, c: spark.range(1).select(stats.mcnemar(F.lit(b), F.lit(c)).alias("p")).first().p
    exact = lambda b, c: min(1, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
    assert p(98, 35) == pytest.approx(exact(98, 35), rel=1e-9) and p(0, 0) is None and p(1, 1) == 1.0
    h = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double").withColumn("f", F.lit(1)), "p", ["f"], ["k"])
    assert {r.k: round(r.p_holm, 9) for r in h.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    df = spark.createDataFrame([(1, 0.1, False), (1, 0.4, True), (1, 0.4, False), (1, 0.9, True)], "g int, x double, y boolean")
    assert stats.auroc(df, "x", "y", ["g"]).first().auroc == 0.875
    assert stats.mann_whitney(df, "x", "y", ["g"]).first().u == 3.5
    m = spark.range(1).select(*(c.alias(k) for k, c in stats.metrics(*(F.lit(v) for v in (493, 88, 209, 3243))).items())).first()
    assert [round(m[k], 4) for k in ("precision", "recall", "f1", "specificity", "accuracy", "balanced_accuracy", "mcc")] == [0.8485, 0.7023, 0.7685, 0.9736, 0.9264, 0.8379, 0.7298]
    assert spark.range(1).select(*(c.alias(k) for k, c in stats.metrics(*(F.lit(0),) * 4).items())).first().precision is None


def test_bootstrap_weights(spark):
    w = stats.bootstrap_weights(spark, list("abcde"), 20)
    assert {r.s for r in w.groupBy("rep").agg(F.sum("w").alias("s")).collect()} == {5}


def test_certainty(spark):
    assert one(spark, retrieval.certainty_name(retrieval.certainty_score(F.lit(4), F.col("d"), F.lit(0))), d=2) == "LOW"
    passages = spark.createDataFrame([(1, "q", 0.5, 0.1), (2, "q", 0.9, 0.1)], "chunk_idx int, q string, rrf double, best double")
    bodies = spark.createDataFrame([(1, "x", 4), (1, "y", 2)], "chunk_idx int, body_id string, score int")
    a = {r.chunk_idx: (r.certainty, r.bodies) for r in retrieval.annotate(passages, bodies).collect()}
    assert a == {1: (2, "x, y"), 2: (None, None)}
    v = retrieval.provenance_violations(spark.createDataFrame([("x",), ("y",)], "body_id string"), spark.createDataFrame([("x", "s", True)], "body_id string, study_id string, include boolean"), spark.createDataFrame([("s", 1)], "study_id string, chunk_idx int"))
    assert sorted(tuple(r) for r in v.collect()) == [("y", "NO_CHUNK_RESOLVES"), ("y", "NO_INCLUDED_STUDY")]


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (3, None)], "k int, v string")
    assert [r.k for r in contracts.conflicts(a, ["k"], "v").collect()] == [2]
    assert [tuple(r) for r in contracts.agreed(a, ["k"], "v").collect()] == [(1, "x")]
    assert [r.k for r in contracts.duplicates(a, ["k"]).collect()] == [2]
    assert contracts.find_column(a, ["Q", "K"]) == "k"
    with pytest.raises(ValueError):
        contracts.require_columns(a, ["w"])


@pytest.mark.parametrize(
    "text, want",
    [('{"a": 1}', {"a": 1}), ('{"a": N/A, "b": 1,}', {"a": "N/A", "b": 1}), ('{"a": “x”}', {"a": "x"}), ('{"a": 1\n"b": 2}', {"a": 1, "b": 2}), ("{'a': True}", {"a": True}), ("nothing", None), (None, None)],
)
def test_tolerant(text, want):
    assert parsing.tolerant(text) == want


def test_first_object():
    assert parsing.first_object('x ```json {"a": "}{", "b": {"c": 1}} ``` {"d": 2}') == '{"a": "}{", "b": {"c": 1}}'
    assert parsing.first_object('{"a": ') is None


def test_sources(spark, tmp_path):
    notes = spark.createDataFrame([("2", "2020-01-02", "b"), ("1", "bad", "a"), ("1", "2020-01-01", " "), ("3", None, None)], "PAT_ID string, CONTACT_DATE string, Clean_note_text string")
    got = io.load_notes(notes).orderBy("_run_row_index").collect()
    assert [(r._run_row_index, r.PAT_ID, str(r.CONTACT_DATE)[:10]) for r in got] == [(0, "1", "None"), (1, "2", "2020-01-02")]
    io.write_by_status(notes.withColumn("status", F.lit("valid")), str(tmp_path / "out"))
    assert io.resume(notes, str(tmp_path / "out"), ["PAT_ID", "CONTACT_DATE"]).count() == 1  # a null key equals nothing
    assert io.resume(notes, str(tmp_path / "none"), ["PAT_ID"]).count() == 4
    (tmp_path / "c.csv").write_text('a,b\n001,\n"x, y",NA\n')
    assert [tuple(r) for r in io.text_csv(spark, str(tmp_path / "c.csv")).collect()] == [("001", ""), ("x, y", "NA")]
    assert len(io.manifest(spark, str(tmp_path / "c.csv")).first().sha256) == 64
    assert "\\&" in io.latex_table([("a&b", 1.5, None)], ["x", "y", "z"], "t")


def test_marked_text(spark):
    s = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("T").alias("tag")))
    assert one(spark, io.tagged(F.col("c"), s), c="a <b> c") == "a [[<b|T]]> c"
    assert one(spark, io.html(F.col("c"), s), c="a <b> c") == 'a <mark class="T">&lt;b</mark>&gt; c'


def test_stream_is_the_batch(spark, data, tmp_path):
    from lodestrata.sources.tables import table
    from lodestrata.streaming.wrap import run_batches, windowed_counts

    batch = table(spark, data, "events")
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run_batches(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("event_type").agg(F.sum("count").alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.groupBy("event_type").count().collect()}
    assert windowed_counts(batch).agg(F.sum("n")).first()[0] == batch.count()


STRUCTURE = [
        ("Rectal bleeding", "melena", "melena", "Patient has melena today.", []),
        ("Rectal bleeding", "melena", "vomiting, melena", "Denies fever, nausea, vomiting,  melena", ["LONG_NEGATED_LIST_SCOPE", "NEGATED_LIST_SCOPE"]),
        ("Rectal bleeding", "melena", "melena", "Denies fever. Has melena", []), ("Rectal bleeding", "melena", "melena", "Denies fever but has melena", []),
        ("Rectal bleeding", "melena", "melena", "no current melena", ["NEGATED_LIST_SCOPE"]), ("Rectal bleeding", "melena", "absent text", "nothing here", ["CANDIDATE_LOCATION_UNRESOLVED"]),
        ("Rectal bleeding", "melena", "melena", "Review of systems: positives in bold. fever melena", ["UNMARKED_ITEM_IN_POLARITY_MARKED_ROS"]),
        ("Rectal bleeding", "melena", "melena", "Review of systems: positives in bold. fever + melena", []), ("Rectal bleeding", "melena", "melena", "Problem list: melena", ["PROBLEM_LIST_ONLY_CONTEXT"]),
        ("Constipation", "hard stools", "hard stools", "has hard stools", ["BROAD_ALIAS_WITHOUT_CORROBORATION", "BROAD_ALIAS_WITHOUT_STRICT_CORROBORATION"]),
        ("Constipation", "hard stools", "hard stools", "has hard stools and takes senna", []),
        ("Family history of colorectal cancer", "crc in family", "crc in family", "mother is worried about colon cancer, crc in family", ["FAMILY_MEMBER_CONCERN_NOT_FAMILY_HISTORY"]),
    ]


def test_structural_failures(spark):
    from lodestrata.functions import structure as S

    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(STRUCTURE)], "i int, f string, a string, q string, n string")
    got = {r.i: r.failures for r in S.structural_failures(df, "f", "a", "q", "n").collect()}
    assert [got[i] for i in range(len(STRUCTURE))] == [c[4] for c in STRUCTURE]


def test_recovery_and_helpers(spark):
    from lodestrata.functions import structure as S
    from lodestrata.operators import recovery as R

    notes = spark.createDataFrame([(1, "Denies nausea, melena. Later had melena at home."), (2, None), (3, "no melena")], "k int, t string")
    ok, audit = R.recovery_scan(notes, "k", "t", {"Rectal bleeding": V.ALIASES["Rectal bleeding"]})
    assert [(r.k, r.quote) for r in ok.collect()] == [(1, "later had melena at home.")] and audit.count() == 1
    near = spark.range(1).select(S.nearest_alias(F.lit("melena and then melena again"), F.lit("melena"), F.lit(17), F.lit(23)).alias("r")).first().r
    assert tuple(near) == (17, 23)
    assert spark.range(1).select(S.longest_alias(F.lit("has rectal pain"), ("pain", "rectal pain")).alias("r")).first().r == "rectal pain"
    v = spark.range(1).select(R.query_variants(F.lit("Melena"), F.array(F.lit("melena")), F.array(F.lit("bleeding")), F.array(F.lit("GI"))).alias("v")).first().v
    assert [(x.name, x["query"]) for x in v] == [("base", "melena"), ("ontology_expanded", "melena bleeding gi")]
    g = lambda *a: spark.range(1).select(R.guarded_proposal(*a).alias("r")).first().r
    none = F.array().cast("array<string>")
    assert g(F.lit("No"), F.lit("Yes"), F.lit(True), none, F.lit(False)) == "Yes" and g(F.lit("No"), F.lit("Yes"), F.lit(False), none, F.lit(False)) == "No"
    assert g(F.lit("No"), F.lit("odd"), F.lit(True), none, F.lit(False)) == "No" and g(F.lit("No"), F.lit("Yes"), F.lit(False), none, F.lit(True)) == "Yes"
    row = {"body_id": "b", "finding": "Diarrhea", "start": "4", "upgrade": "0", "final": "moderate", "protocol": "p", "origin": "o", **{d: "not serious" for d in R.DOMAINS}, **{f"{d}_rationale": "" for d in R.DOMAINS}}
    bad = {**row, "body_id": "c", "imprecision": "serious", "final": "HIGH"}
    p = spark.createDataFrame([row, {**row, "imprecision": "serious", "imprecision_rationale": "few", "body_id": "d"}, bad])
    got = {r.body_id: r.violations for r in R.profile_violations(p, V.FINDINGS).collect()}
    assert got == {"b": ["CERTAINTY_DOES_NOT_FOLLOW"], "d": [], "c": ["IMPRECISION_WITHOUT_RATIONALE", "CERTAINTY_DOES_NOT_FOLLOW"]}
    assert one(spark, R.prompt("Note {c}!", c=F.col("c")), c="x") == "Note x!"
    w = spark.createDataFrame([(1, "4")], "k int, `Diarrhea confidence` string")
    assert [tuple(r) for r in R.confidence_of(w, "k", ("Diarrhea", "Constipation")).collect()] == [(1, "Diarrhea", 4.0), (1, "Constipation", None)]


def test_dense_search_of_every_hundredth_row(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    from lodestrata.plans.score_queries import dense_search

    rows = sorted((r.vec_id, r.embedding) for r in e.select("vec_id", "embedding").collect())
    v = np.array([x for _, x in rows], np.float64)
    want = set()
    for i, (q, _) in enumerate(rows):
        if q % 100 == 0:
            s = np.round(v @ v[i], 9)
            want |= {(q, rows[j][0], r + 1) for r, j in enumerate(sorted(range(len(rows)), key=lambda j: (-s[j], rows[j][0]))[:32])}
    assert {(r.q, r.vec_id, r["rank"]) for r in dense_search(spark, data).collect()} == want
    small = retrieval.dense_search(e, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 32, query_block=3, vector_block=100)
    assert {(r.q, r.vec_id, r["rank"]) for r in small.collect()} == want
    assert retrieval.dense_search(e.limit(0), "vec_id", "embedding", F.lit(True), 3).count() == 0


def test_hashed_bootstrap(spark, data):
    from lodestrata.plans.score_queries import bootstrap_full

    rng = np.random.default_rng(5)
    w = stats.hashed_weights(rng.integers(0, 2**63, 400).astype(np.uint64), np.arange(5000))
    assert len(np.unique(w, axis=0)) == 5000 and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    units = ["-", "UNKNOWN", "7", "8", "9"]
    rows = [(u, f, i, 2 * i, 1) for i, u in enumerate(units) for f in ("a", "b")]
    df = spark.createDataFrame(rows, "u string, f string, tp int, fp int, fn int")
    h = np.array([r.h for r in spark.createDataFrame([(u,) for u in units], "u string").select(F.xxhash64("u").alias("h")).collect()]).view(np.uint64)
    want = stats.hashed_weights(h, np.arange(300)) @ np.array([(i, 2 * i, 1) for i in range(5)])
    got = {(r.rep, r.f): (r.tp, r.fp, r.fn) for r in stats.bootstrap_hashed(df.repartition(3), "u", "f", ["tp", "fp", "fn"], 300).collect()}
    assert got == {(i, f): tuple(x) for i, x in enumerate(want.tolist()) for f in ("a", "b")}
    full = bootstrap_full(spark, data).collect()
    assert {(r.unit, r.reps) for r in full} == {("note", 5000), ("patient", 2000)} and all(r.low is None or r.low <= r.high and 0 < r.p <= 1 for r in full)
