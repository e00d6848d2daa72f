"""Hand-written cases of the rules over notes and claims."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodestrata.functions import normalize as N
from lodestrata.functions import policy as P
from lodestrata.functions import structure as S
from lodestrata.functions import vocabulary as V
from lodestrata.operators import claims as C
from lodestrata.operators import loop, stats
from lodestrata.operators import text as T


def one(spark, *cols):
    r = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
    return r[0] if len(cols) == 1 else tuple(r)


def lit(v):
    return F.lit(v).cast("string") if v is None else F.lit(v)


def test_labels_and_inferences(spark):
    assert one(spark, *(N.label(lit(x)) for x in ("not mentioned outside ROS", " Yes ", "maybe", None))) == ("No", "Yes", None, None)
    assert one(spark, *(N.usable_inference(lit(x)) for x in ("No documentation of it", "not documented in the note", "denies pain", "short", None, "\u00a0\u00a0 real text"))) == (False, False, True, False, False, True)
    assert one(spark, N.no_quotation(lit("Only in ROS-negative context")), N.no_quotation(lit("she bled"))) == (True, False)


def test_context_is_bounded_and_looks_at_every_place(spark):
    codes = lambda f, a, q: one(spark, P.context_failures(lit(f), lit(a), lit(q)))
    assert codes("Rectal bleeding", "fit", "a benefit was recommended; fit ok") == [] and "ADVICE_OR_PREVENTION_CONTEXT" in codes("Rectal bleeding", "fit", "we recommend fit")
    assert codes("Diarrhea", "diarrhea", "diarrhea yes; later diarrhea: none") == ["EXPLICIT_NONE_CONTEXT"]
    assert codes("Diarrhea", None, "  ") == ["EMPTY_CANDIDATE"] and codes("Diarrhea", None, "loose") == []
    assert "TEST_OR_ORDER_ONLY" in codes("Rectal bleeding", "occult blood", "occult blood test ordered") and codes("Rectal bleeding", "occult blood", "occult blood test positive") == []


def test_a_denied_first_mention_hides_nothing(spark):
    note = "Denies diarrhea.\n" + "x " * 40 + "\nLater loose stool and diarrhea again."
    df = spark.createDataFrame([(1, note), (2, "ROS:\ndiarrhea\nPlan:\nrest"), (3, None), (4, "")], "k int, t string")
    got = {(r.k, r.feature) for r in T.present_outside(df, "k", "t", V.ALIASES).collect()}
    assert got == {(1, "Diarrhea")}


def test_sections(spark):
    split = lambda t: one(spark, *P.split_section(lit(t)))
    assert split("HPI\nROS:\nno pain\nOther:\nstill inside\nPlan:\nrest") == ("HPI\nPlan:\nrest", "ROS:\nno pain\nOther:\nstill inside\n")
    assert split("Seen. ros: negative throughout") == ("Seen. ", "ros: negative throughout") and split("nothing") == ("nothing", "")


def test_family_history(spark):
    rule = lambda t: one(spark, S.family_history(lit(t)))
    assert [rule(t) for t in ("dad with colon or rectal cancer", "CRC in a first-degree relative", "mother\nhad colon cancer", "mother well. Colon cancer screening", "ROS:\nmother had crc")] == [True, True, True, False, False]


def test_semantics_and_change_types(spark):
    fam = V.FAMILY
    codes = lambda *a: one(spark, P.semantic_failures(*(lit(x) for x in a)))
    assert codes(fam, "Mother had colon cancer", "Affirmed", "family_member", "maternal aunt", "colon cancer") == []
    assert len(codes(fam, "screening", "negated", "patient", None, None)) == 6 and codes("Diarrhea", "x", "historical", "unknown", None, None) == [P.SEMANTIC["patient"]]
    kind = lambda b, a, e=False, m=False, err=False: one(spark, loop.change_type(lit(b), lit(a), F.lit(e), F.lit(m), F.lit(err)))
    assert [kind("No", "No"), kind("Yes", "maybe"), kind("Yes", "No"), kind("No", "Yes"), kind("Yes", "Yes", True), kind("No", "No", False, True), kind("Yes", "No", err=True)] == [
        "CONFIRMED", "LABEL_CHANGED", "REJECTED", "RECOVERED", "EVIDENCE_CORRECTED", "METADATA_CORRECTED", "REFINEMENT_ERROR",
    ]


def test_negatives_are_rewritten(spark):
    claim = lambda inf, sec, exp, asr: {"label": lit("No"), "confidence": F.lit(3), "inference": lit(inf), "section": lit(sec), "experiencer": lit(exp), "assertion": lit(asr)}
    new, changes, ok = S.normalise_negative(claim("denies pain", "nowhere", "robot", "denied"), lit("Diarrhea"), F.lit(True))
    assert one(spark, new["inference"], new["section"], new["experiencer"], new["assertion"], ok) == ("denies pain", "unknown", "unknown", "negated", True)
    new, changes, ok = S.normalise_negative(claim("tea", "hpi", "patient", "affirmed"), lit("Diarrhea"), F.lit(False))
    assert one(spark, new["inference"], new["section"], new["assertion"], ok) == (V.NOT_DOCUMENTED, "none", "unknown", True) and len(one(spark, changes)) == 4


def test_refinement_guards(spark):
    fields = "note_section string, experiencer string, assertion_status string, relation_found string, cancer_type_found string"
    new = ", ".join("new_" + x for x in fields.split(", "))
    res = ", ".join("rescue_" + x for x in fields.split(", "))
    schema = f"k int, feature string, prediction string, evidence_quote string, {fields}, verdict string, new_prediction string, new_evidence string, {new}, rescue_evidence string, {res}, rescue_used boolean, note string"
    old, good, none = ("hpi", "patient", "affirmed", "", ""), ("hpi", "patient", "affirmed", "", ""), (None,) * 5
    note = "She has loose stools daily."
    row = lambda k, p, v, np, ne, nf, re=None, rf=none, used=False, n=note: (k, "Diarrhea", p, "loose stools", *old, v, np, ne, *nf, re, *rf, used, n)
    rows = [
        row(0, "Yes", "VERIFIED", None, None, none), row(1, "Yes", "REFINE", "Yes", "not there at all", good), row(2, "Yes", "REFINE", "No", "", ("", "", "", "", ""), "loose stools daily", good),
        row(3, "Yes", "REFINE", "No", "", ("", "", "", "", ""), "loose stools daily", good, True), row(4, "No", "REFINE", "Yes", "loose stools daily", good), row(5, "No", "REFINE", "maybe", "", none), row(6, "Yes", "REFINE", "Yes", "loose stools", good, n=" "),
        row(7, "Yes", None, "Yes", "loose stools", good),
    ]
    got = {r.k: (r.corrected_prediction, r.change_type, r.rescued, r.reason) for r in C.refine(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == ("Yes", "UNCHANGED", False, None) and got[1] == ("No", "REJECTED", False, "UNGROUNDED") and got[2][:3] == ("Yes", "EVIDENCE_CORRECTED", True)
    assert got[3][:3] == ("No", "REJECTED", False) and got[4][:2] == ("Yes", "RECOVERED") and got[5][1] == got[6][1] == got[7][1] == "REFINEMENT_ERROR"


def test_digest_weights_are_independent():
    w = stats.digest_weights([f"unit {i}" for i in range(3000)], 200)
    assert w.shape == (3000, 200) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    totals = w.sum(axis=0)  # independent draws: the total of a replicate has a deviation of the root of the units
    assert 0.8 < totals.std() / math.sqrt(3000) < 1.2 and len(np.unique(w, axis=0)) == 3000


def test_student():
    assert abs(stats.student_two_sided(2.0, 10) - 0.07338803477074057) < 1e-12 and abs(stats.student_two_sided(0.5, 3) - 0.6514479648481512) < 1e-12 and stats.student_two_sided(0.0, 5) == 1.0


def test_mcnemar_of_many_pairs(spark):
    assert abs(one(spark, stats.mcnemar(F.lit(98), F.lit(35))) - 4.29e-08) < 1e-10 and one(spark, stats.mcnemar(F.lit(0), F.lit(0))) is None
    assert one(spark, stats.mcnemar(F.lit(5000), F.lit(5000))) == 1.0


def test_retries_never_change_a_label(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    take = lambda a, b, x, y, l, m: one(spark, C.accept_retry(a, b, F.lit(x), F.lit(y), lit(l), lit(m)))
    assert [take(arr("i"), arr(), None, None, "Yes", "Yes"), take(arr("i"), arr("j"), 0.0, 0.9, "Yes", "Yes"), take(arr(), arr(), 0.05, 0.06, "No", "No"), take(arr(), arr(), 0.05, 0.04, "No", "No"), take(arr(), arr(), 0.0, 0.9, "No", "Yes")] == [
        True, False, True, False, False,
    ]


def test_last_before_over_ranges(spark):
    import random

    from lodestrata.operators.contracts import last_before

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", None, None])) for i in range(300)]
    want, last = {}, {}
    for i, k, v in rows:
        want[i] = last.get(k)
        last[k] = v or last.get(k)
    df = spark.createDataFrame(rows, "i bigint, k string, v string")
    for width in (7, 1000):
        assert {r.i: r.known for r in last_before(df, ["k"], "i", "v", "known", width).collect()} == want
