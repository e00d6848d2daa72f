"""Structural rules over a whole note (P6, P7, P11-P13, M8-M12, M16, M17, P1b) as Column builders.

Places are 1-based. A window before a place is cut out once and the last cue in it found by a greedy prefix, so each
rule is one or two linear patterns over a short text, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V
from .normalize import no_quotation, strip
from .policy import any_of, assertion_in, has_cancer, has_relation, split_section

# Headers, cues and corroborating words of the structural rules.
HEADERS = (
    r"chief complaint|history of present illness|hpi|interval history|interval hx|review of systems|review of symptoms|ros|patient active problem list|active problem list|problem list|"
    r"past medical history|pmh|family history|assessment and plan|assessment/plan|assessment|plan|physical exam|physical examination|objective|subjective"
)
PROBLEM_LISTS = ("patient active problem list", "active problem list", "problem list")
STRONG_NEGATION = r"negative\s+for|neg\s+for|denies|denied|without|no\s+evidence\s+of|pertinent\s+negatives?\s+(?:include|includes|included)"
SCOPE_BREAK = r"[.;\n]|\bbut\b|\bhowever\b|\bexcept\b|\balthough\b|\bwhereas\b"
MARKED_ROS = r"review\s+of\s+(?:systems|symptoms).{0,160}?positives?\s+(?:are\s+)?(?:in\s+)?bold"
NEGATIVE_ROS = r"\b(?:ros|review\s+of\s+systems|review\s+of\s+symptoms)\b.{0,500}?\bnegative\s+unless\s+(?:bold|bolded|marked)\b"
LOOSE = (
    r"diarrhea|loose\s+(?:stool|stools|bowel movements?|bms?)|watery\s+(?:stool|stools|bowel movements?|bms?)|liquid\s+(?:stool|stools|bowel movements?|bms?)|runny\s+(?:stool|stools)"
)
NO_DIARRHEA = r"\b(?:no|denies|denied|without|negative\s+for|neg\s+for)\b.{0,80}\bdiarrhea\b"
HARD = (
    r"constipation|constipated|straining|difficult(?:y)?\s+(?:passing|with)\s+(?:stool|stools|bowel movements?|bms?)|infrequent\s+(?:stool|stools|bowel movements?|bms?)|"
    r"no\s+(?:bowel movement|bm)\b|stool\s+softener|miralax|senna|laxative"
)
REMOTE = r"\b(?:pmh|past\s+medical\s+history|history\s+of)\b.{0,260}?\b(?:diagnosed|diagnosis)\b.{0,160}?\bafter\s+presenting\s+with\b"
CONCERN = (
    r"\b(?:mother|father|mom|dad|sister|brother|sibling|grandmother|grandfather|grandparent|gm|gf|mgm|mgf|pgm|pgf|aunt|uncle|daughter|son)\b.{0,80}?"
    r"\b(?:concerned|concern|worried|worry|fearful|fears?)\b.{0,120}?\b(?:colon|colorectal|rectal|bowel)\b.{0,20}?\b(?:cancer|carcinoma|ca)\b"
)
BROAD_LOOSE, BROAD_HARD = ("frequent bowel movement", "frequent bowel movements"), ("hard stool", "hard stools")


def before(text: Column, at: Column, reach: int) -> Column:
    low = F.greatest(F.lit(1), at - reach)
    return text.substr(low, at - low)


def around(text: Column, start: Column, end: Column, left: int, right: int) -> Column:
    low = F.greatest(F.lit(1), start - left)
    return text.substr(low, end + right - low)


def after_last(text: Column, pattern: str) -> Column:
    """What follows the last match in a text, or null."""
    found = r"(?is)^.*(?:" + pattern + r")"
    return F.when(text.rlike(r"(?is)" + pattern), F.regexp_replace(text, found, ""))


def flexible(text: Column) -> Column:
    """M8: a text as a pattern that takes any white space for white space."""
    return F.concat(F.lit(r"(?i)\Q"), F.regexp_replace(F.trim(text), r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))


def nearest_alias(note: Column, alias: Column, start: Column, end: Column, reach: int = 80) -> Column:
    """M9: struct(start, end) of the alias whose centre is nearest to the candidate's, within ``reach`` of it; the
    candidate itself where there is none, the first of equals."""
    low = F.greatest(F.lit(1), start - reach)
    gaps = F.split(F.lower(note.substr(low, end + reach - low)), F.concat(F.lit(r"(?<!\w)\Q"), F.lower(alias), F.lit(r"\E(?!\w)")), -1)
    n = F.length(alias)
    starts = F.aggregate(
        F.slice(gaps, 1, F.size(gaps) - 1),
        F.struct(low.alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, g: F.struct((s["at"] + F.length(g) + n).alias("at"), F.concat(s["starts"], F.array(s["at"] + F.length(g))).alias("starts")),
    )["starts"]
    best = F.array_min(F.transform(starts, lambda p: F.struct(F.abs(2 * p + n - start - end).alias("far"), p.alias("p"))))["p"]
    return F.when(best.isNotNull() & (n > 0), F.struct(best.alias("start"), (best + n).alias("end"))).otherwise(F.struct(start.alias("start"), end.alias("end")))


def context_quote(text: Column, start: Column, end: Column, reach: int = 100) -> Column:
    """The mention with its surroundings, to the line end, full stop or semicolon on either side (the right one
    included)."""
    left = F.regexp_replace(before(text, start, reach), r"(?s)^.*[\n.;]", "")
    right = F.regexp_extract(text.substr(end, F.lit(reach)), r"(?s)^[^\n.;]*[\n.;]?", 0)
    return F.trim(F.concat(left, text.substr(start, end - start), right))


def longest_alias(quote: Column, aliases: tuple[str, ...]) -> Column:
    """The longest alias in a quotation, the later in the alphabet of equals, or null."""
    q = F.lower(quote)
    hits = F.array_compact(F.array(*(F.when(F.contains(q, F.lit(a)), F.struct(F.lit(len(a)).alias("n"), F.lit(a).alias("a"))) for a in aliases)))
    return F.array_max(hits)["a"]


def plus_marked(note: Column, at: Column) -> Column:
    return before(note, at, 8).rlike(r"\+\s*$")


def nearest_header(note: Column, at: Column) -> Column:
    return F.lower(F.regexp_extract(note.substr(F.lit(1), at - 1), r"(?is)^.*\b(" + HEADERS + r")\b", 1))


def structural_failures(df: DataFrame, feature: str, alias: str, quote: str, note: str, out: str = "failures", strict: bool = True) -> DataFrame:
    """P11 and, if strict, P12: a column of the reasons for which a candidate's place in its note makes it no evidence,
    sorted. A frame function, as the places are columns of their own: every rule reads them, and one expression would
    repeat them a hundred times."""
    c = F.col
    plain = lambda w: F.instr(F.lower(note), F.lower(F.trim(w)))
    d = df.withColumns({"_pq": plain(quote), "_pa": plain(alias)})
    d = d.withColumn("_lq", F.when(c("_pq") > 0, F.substr(note, c("_pq"), F.length(F.trim(quote)))).otherwise(F.regexp_substr(note, flexible(c(quote)))))
    d = d.withColumn("_hit", F.when((F.length(F.trim(quote)) > 0) & (F.length("_lq") > 0), c("_lq")).when((F.length(F.trim(alias)) > 0) & (c("_pa") > 0), F.substr(note, c("_pa"), F.length(F.trim(alias)))))
    d = d.withColumn("_s", F.instr(note, c("_hit"))).withColumn("_e", c("_s") + F.length("_hit"))
    d = d.withColumn("_a", nearest_alias(c(note), c(alias), c("_s"), c("_e"))).withColumns({"_as": c("_a")["start"], "_ae": c("_a")["end"]})
    n, start, end = c(note), c("_as"), c("_ae")
    tails = {"_tn": after_last(before(n, start, 400), r"\b(?:" + STRONG_NEGATION + r")\b"), "_tm": after_last(before(n, start, 900), MARKED_ROS), "_near": around(n, start, end, 180, 220)}
    if strict:
        scope = F.regexp_replace(before(n, start, 1400), r"(?s)^.*[.;\n]", "")
        tails |= {"_tl": after_last(scope, r"\b(?:" + STRONG_NEGATION + r")\b"), "_tr": after_last(before(n, start, 1000), NEGATIVE_ROS), "_wide": around(n, start, end, 220, 320)}
    d = d.withColumns(tails)
    f, name = F.lower(feature), F.lower(F.regexp_replace(F.trim(alias), r"\s+", " "))
    loose, hard, plus = f == "diarrhea", f == "constipation", plus_marked(n, start)
    or_no = lambda x: F.coalesce(x, F.lit(False))
    checks = {
        "NEGATED_LIST_SCOPE": or_no((F.length("_tn") <= 300) & ~c("_tn").rlike(r"(?i)" + SCOPE_BREAK)) | before(n, start, 35).rlike(r"(?i)\bno\s+(?:current\s+)?$"),
        "UNMARKED_ITEM_IN_POLARITY_MARKED_ROS": or_no(F.length("_tm") <= 700) & ~plus,
        "PROBLEM_LIST_ONLY_CONTEXT": nearest_header(n, start).isin(*PROBLEM_LISTS),
        "BROAD_ALIAS_WITHOUT_CORROBORATION": name.isin(*BROAD_LOOSE, *BROAD_HARD) & ((loose & ~c("_near").rlike(any_of([LOOSE]))) | (hard & ~c("_near").rlike(any_of([HARD])))),
    }
    if strict:
        checks |= {
            "LONG_NEGATED_LIST_SCOPE": or_no(~c("_tl").rlike(r"(?i)\b(?:but|however|except|although|whereas)\b")),
            "UNMARKED_ITEM_IN_NEGATIVE_UNLESS_BOLDED_ROS": or_no(F.length("_tr") <= 750) & ~plus,
            "BROAD_ALIAS_WITHOUT_STRICT_CORROBORATION": (loose & name.isin(*BROAD_LOOSE) & (c("_wide").rlike(r"(?is)" + NO_DIARRHEA) | ~c("_wide").rlike(any_of([LOOSE]))))
            | (hard & name.isin(*BROAD_HARD) & ~c("_wide").rlike(any_of([HARD]))),
            "REMOTE_DIAGNOSTIC_HISTORY_ONLY": around(n, start, end, 420, 260).rlike(r"(?is)" + REMOTE),
            "FAMILY_MEMBER_CONCERN_NOT_FAMILY_HISTORY": (c(feature) == V.FAMILY) & around(n, c("_s"), c("_e"), 180, 220).rlike(r"(?is)" + CONCERN),
        }
    codes = F.array_sort(F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in checks.items()))))
    d = d.withColumn(out, F.when(c("_hit").isNull(), F.array(F.lit("CANDIDATE_LOCATION_UNRESOLVED"))).otherwise(codes))
    return d.select(*df.columns, out)


def quote_in(before: Column, hit: Column, after: Column, reach: int = 100) -> Column:
    """M11 for a mention with what stands around it."""
    left = F.regexp_replace(F.right(before, F.lit(reach)), r"(?s)^.*[\n.;]", "")
    right = F.regexp_extract(F.substring(after, 1, reach), r"(?s)^[^\n.;]*[\n.;]?", 0)
    return F.trim(F.concat(left, hit, right))


def eligible_in(feature: Column, before: Column, hit: Column, after: Column) -> Column:
    """Affirmed or historical, and for the family finding a relative and a cancer within 140 characters, for a
    mention with 140 characters on either side."""
    near = quote_in(before, hit, after, 140)
    return assertion_in(before, hit, F.substring(after, 1, 100)).isin("AFFIRMED", "HISTORICAL") & ((feature != V.FAMILY) | (has_relation(near) & has_cancer(near)))


def family_composites(df: DataFrame, key: str, text: str, keep: int = 3) -> DataFrame:
    """(key, ord, start, quote): places where a cancer is named, without an alias, whose 140 characters on either side
    name a relative too, affirmed or historical; the first ``keep`` of different wording, cancer by cancer."""
    from pyspark.sql import Window

    from .normalize import fold_text

    low = df.select(F.col(key).alias("k"), F.translate(F.col(text), "\x01\x02", "  ").alias("t")).where("t is not null")
    marked = [F.struct(F.lit(i).alias("i"), F.split(F.regexp_replace("t", any_of([p]), "\x01$0\x02"), "\x01").alias("parts")) for i, p in enumerate(V.CANCERS)]
    each = low.select("k", "t", F.explode(F.array(*marked)).alias("e")).where("size(e.parts) > 1").select("k", "t", "e.*")
    cut = F.transform(F.slice("parts", 2, F.size("parts")), lambda x: F.split(x, "\x02"))
    starts = F.aggregate(
        cut,
        F.struct(F.length(F.element_at("parts", 1)).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, x: F.struct((s["at"] + F.length(x[0]) + F.length(x[1])).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
    )["starts"]
    place = lambda s: F.greatest(F.lit(1), s + 1 - 140)
    found = F.transform(
        F.arrays_zip(F.transform(cut, lambda x: x[0]).alias("hit"), starts.alias("start")),
        lambda m: F.struct(m["start"].alias("start"), m["hit"].alias("hit"), F.col("t").substr(place(m["start"]), m["start"] + 1 - place(m["start"])).alias("before"), F.col("t").substr(m["start"] + F.length(m["hit"]) + 1, F.lit(140)).alias("after")),
    )
    m = each.select("k", "i", F.explode(found).alias("m")).select("k", "i", "m.*").where(eligible_in(F.lit(V.FAMILY), F.col("before"), F.col("hit"), F.col("after")))
    m = m.select("k", "i", "start", quote_in(F.col("before"), F.col("hit"), F.col("after"), 140).alias("quote"))
    one = Window.partitionBy("k", fold_text(F.col("quote"))).orderBy("i", "start")
    w = Window.partitionBy("k").orderBy("i", "start")
    c = m.withColumn("_rn", F.row_number().over(one)).where("_rn = 1").withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= keep)
    return c.select(F.col("k").alias(key), "ord", "start", "quote")


def family_history(text: Column) -> Column:
    """Outside the review of systems a relative and a colorectal cancer within 100 characters of one another, no
    full stop or semicolon between, either way round."""
    low = F.lower(split_section(text)[0])
    gap = r"[^.;]{0,100}"
    return low.rlike("(?d)" + V.MEMBER + gap + V.CRC) | low.rlike("(?d)" + V.CRC + gap + V.MEMBER)


def alias_of(c: Column, aliases: dict[str, str]) -> Column:
    """A field in lower case, other spellings replaced."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = t
    for k, v in aliases.items():
        out = F.when(t == k, v).otherwise(out)
    return out


# The codes of P15.
ISSUES = {
    "label": "invalid_or_missing_label", "confidence": "invalid_confidence", "section": "invalid_note_section", "experiencer": "invalid_experiencer", "assertion": "invalid_assertion_status",
    "positive_assertion": "positive_label_requires_affirmed_or_historical_assertion", "positive_patient": "positive_label_requires_patient_experiencer",
    "positive_family": "positive_label_requires_family_member_experiencer", "ungrounded": "positive_inference_not_note_grounded",
    "relation": "family_history_positive_missing_biological_relation", "cancer": "family_history_positive_missing_crc_specificity",
    "negative_assertion": "negative_label_cannot_have_affirmed_hypothetical_planned_or_historical_assertion", "denial": "negated_label_requires_grounded_denial_evidence",
    "leftover": "negative_absence_should_not_retain_affirmative_or_unrelated_inference", "duration": "duration_not_string", "duration_confidence": "invalid_duration_confidence",
    "duration_inference": "duration_inference_not_string",
}


def metadata_issues(claim: dict[str, Column], feature: Column, grounded: Column) -> Column:
    """A claim's own fields against one another and its note. claim has label (Yes, No or null), confidence,
    inference, section, experiencer, assertion and, where the finding has one, duration, duration_confidence and
    duration_inference; grounded says whether the inference is in the note."""
    label, inference, family = claim["label"], strip(F.coalesce(claim["inference"], F.lit(""))), feature == V.FAMILY
    section, assertion = alias_of(claim["section"], V.SECTION_ALIASES), alias_of(claim["assertion"], V.ASSERTION_ALIASES)
    experiencer = alias_of(claim["experiencer"], {})
    low = F.lower(inference)
    yes, no = label == "Yes", label == "No"
    bad = no_quotation(inference) | ~F.coalesce(grounded, F.lit(False))
    absent = no_quotation(inference)
    for p in V.ABSENCE_PREFIXES:
        absent = absent | low.startswith(p)
    off = lambda c: c.isNull() | F.isnan(c.cast("double")) | ~c.cast("double").between(1, 5)
    checks = {
        "confidence": off(claim["confidence"]), "section": ~section.isin(*V.SECTIONS), "experiencer": ~experiencer.isin(*V.EXPERIENCERS), "assertion": ~assertion.isin(*V.ASSERTIONS),
        "positive_assertion": yes & ~assertion.isin("affirmed", "historical"), "positive_patient": yes & ~family & (experiencer != "patient"), "positive_family": yes & family & (experiencer != "family_member"),
        "ungrounded": yes & bad, "relation": yes & family & (inference != "") & ~low.rlike("(?d)" + V.MEMBER), "cancer": yes & family & (inference != "") & ~low.rlike("(?d)" + V.CRC),
        "negative_assertion": no & ~assertion.isin("negated", "absent", "unknown"), "denial": no & (assertion == "negated") & bad, "leftover": no & (assertion != "negated") & ~absent,
    }
    if "duration" in claim:
        checks |= {
            "duration": ~family & claim["duration"].isNull(), "duration_confidence": ~family & off(claim["duration_confidence"]), "duration_inference": ~family & claim["duration_inference"].isNull(),
        }
    codes = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(ISSUES[k])) for k, c in checks.items())))
    return F.when(F.coalesce(label.isin("Yes", "No"), F.lit(False)), codes).otherwise(F.array(F.lit(ISSUES["label"])))


def normalise_negative(claim: dict[str, Column], feature: Column, grounded: Column) -> tuple[dict[str, Column], Column, Column]:
    """(claim, changes, ok): the fields of a "No" that has issues rewritten the one way they can be. A grounded denial
    keeps its inference and has its enumerations put right; any other says that nothing is documented. ok: nothing is
    left to object to; false where nothing was done."""
    before = metadata_issues(claim, feature, grounded)
    due = (claim["label"] == "No") & (F.size(before) > 0)
    inference = strip(F.coalesce(claim["inference"], F.lit("")))
    section, assertion = alias_of(claim["section"], V.SECTION_ALIASES), alias_of(claim["assertion"], V.ASSERTION_ALIASES)
    experiencer, stated = alias_of(claim["experiencer"], {}), F.lower(strip(F.coalesce(claim["assertion"], F.lit(""))))
    denial = (assertion == "negated") & ~no_quotation(inference) & F.coalesce(grounded, F.lit(False))
    off = claim["confidence"].isNull() | ~claim["confidence"].cast("double").between(1, 5)
    known = {"section": section.isin(*V.SECTIONS), "experiencer": experiencer.isin(*V.EXPERIENCERS)}
    new = {
        "label": claim["label"], "confidence": F.when(due & off, 1).otherwise(claim["confidence"]),
        "inference": F.when(due & ~denial, V.NOT_DOCUMENTED).otherwise(claim["inference"]),
        "section": F.when(due & ~denial, "none").when(due, F.when(known["section"], section).otherwise("unknown")).otherwise(claim["section"]),
        "experiencer": F.when(due & ~denial, "unknown").when(due, F.when(known["experiencer"], experiencer).otherwise("unknown")).otherwise(claim["experiencer"]),
        "assertion": F.when(due & ~denial, "unknown").when(due, "negated").otherwise(claim["assertion"]),
    }
    notes = [
        (off, "invalid_confidence->1"), (denial & (assertion != stated), "assertion_alias_normalized"), (denial & ~known["section"], "invalid_section->unknown"),
        (denial & ~known["experiencer"], "invalid_experiencer->unknown"), (~denial & (inference != V.NOT_DOCUMENTED), "unsupported_negative_inference->not_documented"),
        (~denial & (section != "none"), "negative_section->none"), (~denial & (experiencer != "unknown"), "negative_experiencer->unknown"), (~denial & (assertion != "unknown"), "negative_assertion->unknown"),
    ]
    changes = F.array_compact(F.array(*(F.when(due & c, F.lit(name)) for c, name in notes)))
    left = metadata_issues(new, feature, F.coalesce(grounded, F.lit(False)) & denial)
    return new, changes, due & (F.size(left) == 0)


def contradiction(label: Column, found_outside: Column, passage_score: Column, least: float = 12.0) -> Column:
    """A "No" against a mention outside the review of systems and a strong passage becomes a "Yes"."""
    return F.when((label == "No") & found_outside & (passage_score >= least), "Yes").otherwise(label)
