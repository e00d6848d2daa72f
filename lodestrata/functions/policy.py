"""Assertion and context rules (P1-P10, P14, M15-M17, M20, M21) as Column builders; offsets are 1-based like SQL's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .normalize import fold_text, strip


def any_of(patterns: tuple[str, ...] | list[str]) -> str:
    return r"(?i)\b(?:" + "|".join(patterns) + r")\b"


def bounded(term: str) -> str:
    """M1: a term that no word character touches."""
    return r"(?U)(?<!\w)" + re.escape(term).replace(r"\ ", " ") + r"(?!\w)"


def has_phrase(text: Column, term: str) -> Column:
    """M1: whether a term of three characters or more occurs, whatever the case."""
    return F.lower(text).rlike(bounded(term.lower())) if len(term) >= 3 else F.lit(False)


def left_scope(text: Column, start: Column, reach: int = 140, contrast: tuple[str, ...] = V.CONTRAST) -> Column:
    """What stands before, back to a line end, full stop or semicolon, and behind the last contrast."""
    low = F.greatest(F.lit(1), start - reach)
    before = F.regexp_replace(text.substr(low, start - low), r"(?s)^.*[\n.;]", "")
    return F.regexp_replace(before, r"(?is)^.* (?:" + "|".join(contrast) + ") ", "")


def right_scope(text: Column, end: Column, reach: int = 70) -> Column:
    """What follows, up to a line end, full stop or semicolon."""
    return F.regexp_extract(text.substr(end, F.lit(reach)), r"^[^\n.;]*", 0)


def assertion_in(before: Column, hit: Column, after: Column) -> Column:
    """P5 for a mention with up to 140 characters before it and 100 after it: NEGATED > PLANNED > HYPOTHETICAL >
    HISTORICAL > AFFIRMED."""
    scope = F.regexp_replace(F.regexp_replace(before, r"(?s)^.*[\n.;]", ""), r"(?is)^.* (?:" + "|".join(V.CONTRAST) + ") ", "")
    behind = F.regexp_extract(F.substring(after, 1, 70), r"^[^\n.;]*", 0)
    local = F.concat(F.right(before, F.lit(100)), hit, F.substring(after, 1, 100))
    return (
        F.when(scope.rlike(any_of(V.NEGATED_BEFORE)) | behind.rlike(any_of(V.NEGATED_AFTER)), "NEGATED")
        .when(local.rlike(any_of(V.PLANNED)), "PLANNED")
        .when(local.rlike(any_of(V.HYPOTHETICAL)), "HYPOTHETICAL")
        .when(local.rlike(any_of(V.HISTORICAL)), "HISTORICAL")
        .otherwise("AFFIRMED")
    )


def assertion_class(text: Column, start: Column, end: Column) -> Column:
    """P5 for the mention text[start, end), 1-based."""
    low = F.greatest(F.lit(1), start - 140)
    return assertion_in(text.substr(low, start - low), text.substr(start, end - start), text.substr(end, F.lit(100)))


def negated_in(before: Column, after: Column) -> Column:
    """A cue in what stands within reach before or after a mention."""
    return before.rlike(any_of(V.PRE_NEGATION)) | after.rlike(any_of(V.POST_NEGATION))


def negated_near(text: Column, start: Column, end: Column, reach: int = 40) -> Column:
    """A cue within ``reach`` characters of the mention text[start, end), 1-based."""
    low = F.greatest(F.lit(1), start - reach)
    return negated_in(text.substr(low, start - low), text.substr(end, F.lit(reach)))


def prefix_denied(before: Column, reach: int = 25) -> Column:
    """One of the plain cues in the last ``reach`` characters before a mention."""
    near = F.lower(F.right(before, F.lit(reach)))
    out = F.lit(False)
    for cue in V.DENIAL_PREFIXES:
        out = out | F.contains(near, F.lit(cue))
    return out


def quote_negation(quote: Column, feature: Column, aliases: dict[str, tuple[str, ...]], reach: int = 40) -> Column:
    """UNKNOWN (no quotation), NO_TARGET_FOUND, AFFIRMED, NEGATED (one cue) or POSSIBLE_DOUBLE_NEGATION, by the
    distinct cues within ``reach`` characters of the mentions of the finding's aliases or name. A cue inside a longer one
    counts too, as both are on the list."""
    q = F.lower(quote)
    hits, gaps = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for name, terms in aliases.items():
        one = r"(?U)(?<!\w)(?:" + "|".join(re.escape(t) for t in sorted({*terms, name.lower()}, key=lambda t: (-len(t), t))) + r")(?!\w)"
        hits = F.when(feature == name, F.regexp_extract_all(q, F.lit(one), F.lit(0))).otherwise(hits)
        gaps = F.when(feature == name, F.split(q, one, -1)).otherwise(gaps)
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    walk = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), F.lit("").alias("after")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), s["before"]).otherwise(F.concat(s["before"], F.lit("\n"), F.right(F.substr(q, F.lit(1), s["at"] + F.length(x["gap"])), F.lit(reach)))).alias("before"),
            F.when(x["hit"].isNull(), s["after"]).otherwise(F.concat(s["after"], F.lit("\n"), F.substr(q, s["at"] + F.length(x["gap"]) + F.length(x["hit"]) + 1, F.lit(reach)))).alias("after"),
        ),
    )
    found = [F.when(walk["before"].rlike(r"\b" + re.escape(c) + r"\b"), F.lit(c)) for c in V.QUOTE_CUES_BEFORE]
    found += [F.when(walk["after"].rlike(r"\b" + re.escape(c) + r"\b"), F.lit(c)) for c in V.QUOTE_CUES_AFTER]
    n = F.size(F.array_distinct(F.array_compact(F.array(*found))))
    return (
        F.when(quote.isNull() | (quote == ""), "UNKNOWN").when(F.size(hits) == 0, "NO_TARGET_FOUND").when(n >= 2, "POSSIBLE_DOUBLE_NEGATION").when(n == 1, "NEGATED").otherwise("AFFIRMED")
    )


def has_relation(text: Column) -> Column:
    """A relative is named."""
    return text.rlike(any_of(V.RELATIONS))


def has_cancer(text: Column) -> Column:
    """A kind of colorectal cancer is named."""
    return text.rlike(any_of(V.CANCERS))


def context_failures(feature: Column, alias: Column, quote: Column) -> Column:
    """P10: the reasons for which a quotation is no evidence, sorted. The alias is a column, so its place is found by
    cutting the quotation at it, as a whole word."""
    known = (F.coalesce(alias, F.lit("")) != "") & ~F.coalesce(alias, F.lit("")).startswith("__")
    low = F.lower(quote)
    one = F.lower(strip(F.coalesce(alias, F.lit(""))))
    parts = F.split(low, F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.when(known, one).otherwise(F.lit("\x00")), F.lit(r"\E(?!\w)")), 2)
    found = known & (F.size(parts) > 1)
    before = F.when(found, left_scope(quote, F.length(parts[0]) + 1, 60)).otherwise(F.lit(""))
    none = F.exists(F.slice(F.split(fold(quote), F.concat(F.lit(r"\Q"), F.when(known, one).otherwise(F.lit("\x00")), F.lit(r"\E"))), 2, 1_000_000), lambda rest: rest.rlike(r"^\s*[:=\-]\s*none\b"))
    checks = {
        "TEST_OR_ORDER_ONLY": (feature == "Rectal bleeding") & (one == "occult blood") & quote.rlike(any_of([V.TEST_ORDER])) & ~quote.rlike(any_of([V.POSITIVE_RESULT])),
        "ADVICE_OR_PREVENTION_CONTEXT": found & before.rlike(any_of([V.ADVICE])),
        "CONDITIONAL_OR_HYPOTHETICAL_CONTEXT": quote.rlike(any_of([V.CONDITIONAL])),
        "EXPLICIT_NONE_CONTEXT": known & none,
        "STRAINING_NOT_BOWEL_CONTEXT": (one == "straining") & ~quote.rlike(any_of([V.BOWEL])),
        "WEIGHT_LOSS_GOAL_OR_PURPOSE": (feature == "Weight loss") & quote.rlike(any_of([V.LOSS_PURPOSE])),
    }
    codes = F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items()))))
    return F.when(strip(F.coalesce(quote, F.lit(""))) == "", F.array(F.lit("EMPTY_CANDIDATE"))).otherwise(codes)


def fold(c: Column) -> Column:
    """A text in lower case with single spaces and straight quotes."""
    return fold_text(c)


def evidence_failures(feature: Column, grounded: Column, affirmed: Column, quote: Column) -> Column:
    """An ungrounded quotation ends the matter; else what else is missing."""
    family = feature == V.FAMILY
    rest = F.array_compact(
        F.array(
            F.when(~affirmed & ~family, "NO_ELIGIBLE_AFFIRMATIVE_TARGET_MENTION"),
            F.when(family & ~has_relation(quote), "FAMILY_RELATION_NOT_EXPLICIT"),
            F.when(family & ~has_cancer(quote), "CRC_TYPE_NOT_EXPLICIT"),
        )
    )
    return F.when(~grounded, F.array(F.lit("EVIDENCE_NOT_GROUNDED"))).otherwise(rest)


def has_any(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether one of some terms occurs in the folded text."""
    t = fold(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(t, F.lit(term))
    return out


# The reasons of P14.
SEMANTIC = {
    "assertion": "positive assertion must be affirmed or historical", "family": "family-history positive must have experiencer=family_member",
    "relation": "family-history positive lacks a recognized biological relation", "cancer": "family-history positive lacks colorectal-cancer specificity",
    "evidence_relation": "grounded evidence does not itself support a family relation", "evidence_cancer": "grounded evidence does not itself support colorectal cancer",
    "patient": "patient symptom positive must have experiencer=patient",
}


def semantic_failures(feature: Column, evidence: Column, assertion: Column, experiencer: Column, relation: Column, cancer: Column) -> Column:
    """What stands against a positive claim: assertion, experiencer and, for the family finding, relation and cancer
    in the fields and in the evidence itself."""
    family = feature == V.FAMILY
    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    checks = {
        "assertion": ~low(assertion).isin("affirmed", "historical"),
        "family": family & (low(experiencer) != "family_member"),
        "relation": family & ~has_any(relation, V.RELATION_TERMS),
        "cancer": family & ~has_any(cancer, V.CRC_TERMS),
        "evidence_relation": family & ~has_any(evidence, V.RELATION_TERMS),
        "evidence_cancer": family & ~has_any(evidence, V.CRC_TERMS),
        "patient": ~family & (low(experiencer) != "patient"),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(SEMANTIC[k])) for k, c in checks.items())))


_AT_LINE = r"(?im)(?d)(?U)^\s*(?:"


def section_bounds(text: Column) -> tuple[Column, Column]:
    """(first place, place behind the last) of the review of systems, 1-based; (0, 0) where there is none. It begins
    at the first line that is one of its headers, else at the first of the inline headers, and ends at the next line,
    five characters on at least, that is another section's header."""
    lines = [F.regexp_instr(text, F.lit(_AT_LINE + p + r")\s*:??\s*$")) for p in V.ROS_LINES]
    inline = [F.instr(F.lower(text), p) for p in V.ROS_INLINE]
    first = lambda cs: F.least(*(F.when(c > 0, c) for c in cs))
    start = F.coalesce(first(lines), first(inline), F.lit(0))
    tail = F.substr(text, start + 5)
    # a line that is cut by the five characters is no beginning of a line: one character stands in for what is before it
    after = F.regexp_instr(F.concat(F.lit("x"), tail), F.lit(_AT_LINE + "|".join(V.ROS_ENDS) + r")\s*:??\s*$"))
    whole = F.regexp_instr(tail, F.lit(_AT_LINE + "|".join(V.ROS_ENDS) + r")\s*:??\s*$"))
    newline = text.substr(start + 4, F.lit(1)) == "\n"
    at = F.when(newline, whole).otherwise(F.when(after > 1, after - 1).otherwise(0))
    end = F.when(at > 0, start + 4 + at).otherwise(F.length(text) + 1)
    return start, F.when(start > 0, end).otherwise(0)


def split_section(text: Column) -> tuple[Column, Column]:
    """(outside, inside) of the review of systems."""
    start, end = section_bounds(text)
    return F.when(start > 0, F.concat(text.substr(F.lit(1), start - 1), F.substr(text, end))).otherwise(text), F.when(start > 0, text.substr(start, end - start)).otherwise(F.lit(""))


def split_section_by_names(text: Column, names: tuple[str, ...] = V.ROS_NAMES, ends: tuple[str, ...] = V.ROS_NAME_ENDS, reach: int = 20) -> tuple[Column, Column]:
    """The same by plain texts: from the first of some names to the first of some others, ``reach`` on at least."""
    low = F.lower(text)
    start = F.coalesce(F.least(*(F.when(F.instr(low, n) > 0, F.instr(low, n)) for n in names)), F.lit(0))
    later = [F.call_function("locate", F.lit(e), low, start + reach) for e in ends]
    end = F.coalesce(F.least(*(F.when(x > 0, x) for x in later)), F.length(text) + 1)
    outside = F.when(start > 0, F.concat(text.substr(F.lit(1), start - 1), F.substr(text, end))).otherwise(text)
    return outside, F.when(start > 0, text.substr(start, end - start)).otherwise(F.lit(""))


def template_score(text: Column) -> Column:
    """How many signs of a filled-in form a text shows, 0 to 6."""
    out = F.when((F.length(text) < 200) & (F.regexp_count(text, F.lit(V.FORM_WORDS)) >= 5), 1).otherwise(0)
    for s in V.FORM_SIGNS:
        out = out + text.rlike(s).cast("int")
    return out


def source_tier(text: Column, tiers: tuple[tuple[str, str], ...], otherwise: str = "UNCLASSIFIED") -> Column:
    """The first tier, in the order given, whose pattern occurs."""
    first, *rest = tiers
    out = F.when(text.rlike(first[1]), first[0])
    for name, pattern in rest:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def study_tier(text: Column) -> Column:
    """M20 by the fixed lists: struct(tier, marker), the marker being the words found."""
    low = F.lower(text)
    found = [F.when(low.rlike(p), F.struct(F.lit(tier).alias("tier"), F.regexp_extract(low, p, 0).alias("marker"))) for tier, patterns in V.TIERS for p in patterns]
    return F.coalesce(*found, F.struct(F.lit("UNCLASSIFIED").alias("tier"), F.lit(None).cast("string").alias("marker")))
