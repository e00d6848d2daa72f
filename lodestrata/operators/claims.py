"""Claims, verifications and refinements as frames (H15-H19, V1-V6, V10, V12, X7, X9): what a text generator answers is a
table joined by its keys; everything that is done with an answer is an expression over that table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import vocabulary as V
from ..functions.normalize import fold_text, strip, usable_quote
from .loop import change_type

FIELDS = ("note_section", "experiencer", "assertion_status", "relation_found", "cancer_type_found")
# The codes of a verification's issues, by what they are about.
ISSUES = {
    "NOT_APPLICABLE": "MISSING_EVIDENCE", "NONE": "UNGROUNDED_EVIDENCE", "WEAK": "WEAK_GROUNDING", "source_faithfulness": "SOURCE_UNFAITHFUL_OR_UNRESOLVED", "contextual_validity": "CONTEXT_INVALID_OR_UNRESOLVED",
    "direct_support": "DIRECT_SUPPORT_FAILED_OR_UNRESOLVED", "relation_specificity": "RELATION_SPECIFICITY_FAILED_OR_UNRESOLVED", "cancer_specificity": "CRC_SPECIFICITY_FAILED_OR_UNRESOLVED",
    "recovered": "MISSED_GROUNDED_AFFIRMATIVE_EVIDENCE", "label": "INVALID_PREDICTION",
}
# How an issue begins that is an error of operation.
ERROR_PREFIXES = ("VERIFICATION_ERROR:", "VERIFICATION_OPERATIONAL_ERROR:")


def text(c: Column) -> Column:
    """A field without white space around it, empty for null."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def prefer(first: Column, second: Column, default: str = "") -> Column:
    """The first that is not blank, else the second, else a default."""
    return F.coalesce(*(F.when(text(c) != "", text(c)) for c in (first, second)), F.lit(default))


def build_claim(feature: Column, label: Column, confidence: Column, inference: Column, quote: Column, fields: dict[str, Column], source: Column, error: Column) -> list[Column]:
    """The columns of a claim; its fields in lower case, has_evidence for a quotation of more than five characters."""
    return [
        feature.alias("feature"), label.alias("prediction"), confidence.alias("confidence"), inference.alias("original_inference"), text(quote).alias("evidence_quote"),
        *(F.lower(text(c)).alias(k) for k, c in fields.items()), (F.length(text(quote)) > 5).alias("has_evidence"), (feature == V.FAMILY).alias("is_family_history"),
        source.alias("structurer_source"), text(error).alias("structurer_operational_error"),
    ]


def issues(label: Column, level: Column, dimensions: dict[str, Column], recovered: Column, family: Column) -> Column:
    """V1: the codes for which a claim goes to refinement. Yes: grounding that is absent or weak and every dimension that
    did not plainly pass, two of them for the family finding alone; No: recovered evidence; any other label."""
    yes, no = label == "Yes", label == "No"
    passed = lambda c: F.coalesce(c, F.lit(False))
    checks = [(yes & (F.coalesce(level, F.lit("NOT_APPLICABLE")) == k), k) for k in ("NOT_APPLICABLE", "NONE", "WEAK")]
    for k, c in dimensions.items():
        checks.append((yes & ~passed(c) & (family if k in ("relation_specificity", "cancer_specificity") else F.lit(True)), k))
    checks += [(no & passed(recovered), "recovered"), (~F.coalesce(yes | no, F.lit(False)), "label")]
    return F.array_compact(F.array(*(F.when(c, F.lit(ISSUES[k])) for c, k in checks)))


def verification_error(flag: Column, level: Column, found: Column) -> Column:
    """An error of operation: the flag, the level ERROR, or an issue that begins as one; a missing verification too."""
    bad = F.exists(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.upper(strip(x)).startswith(ERROR_PREFIXES[0]) | F.upper(strip(x)).startswith(ERROR_PREFIXES[1]))
    return F.coalesce(flag, F.lit(False)) | (F.upper(text(level)) == "ERROR") | F.coalesce(bad, F.lit(False))


def grounded_in(quote: Column, note: Column) -> Column:
    """A usable quotation that is in the note, as it is or folded."""
    q = text(quote)
    return usable_quote(q) & F.coalesce(F.contains(note, q) | ((fold_text(q) != "") & F.contains(fold_text(note), fold_text(q))), F.lit(False))


def refine(df: DataFrame, note: str = "note", rescue: bool = True) -> DataFrame:
    """What becomes of proposals, by guards in order.

    df: feature, prediction, evidence_quote and FIELDS of the claim; verdict; new_prediction, new_evidence, new_ and each of
    FIELDS of the proposal; rescue_evidence and rescue_ fields (null for none); rescue_used; note. Added: corrected_
    prediction, evidence and fields, rescued, change_type, refined, operational_error, reason.

    Guards: a verified claim stays; another verdict than REFINE, a label that is none, an empty note and a proposal without
    a label are errors that keep the claim. A "Yes" turns to "No" if its evidence is not in the note, if the family finding
    lacks relation or cancer, or by P14. A "Yes" so lost, or given up, may be saved once by a rescue whose own evidence is
    in the note and has no failures. A "No" keeps only evidence that is in the note."""
    c = F.col
    low = lambda name: F.lower(text(c(name)))
    enum = lambda name, allowed, default: F.when(low(name).isin(*allowed), low(name)).otherwise(default)
    error = (
        F.when(c("verdict") == "VERIFIED", F.lit(None)).when(F.coalesce(c("verdict") != "REFINE", F.lit(True)), "UNEXPECTED_VERDICT").when(~F.coalesce(c("prediction").isin("Yes", "No"), F.lit(False)), "INVALID_CLAIM")
        .when(text(c(note)) == "", "EMPTY_NOTE").when(~F.coalesce(c("new_prediction").isin("Yes", "No"), F.lit(False)), "INVALID_PROPOSAL")
    )
    d = df.withColumns(
        {
            "_error": error, "_open": (c("verdict") == "REFINE") & error.isNull(), "_e": text(c("new_evidence")), "_sec": low("new_note_section"), "_exp": enum("new_experiencer", V.EXPERIENCERS, ""),
            "_asr": enum("new_assertion_status", V.ASSERTIONS, "unknown"), "_rel": low("new_relation_found"), "_can": low("new_cancer_type_found"),
        }
    )
    family = c("feature") == V.FAMILY
    d = d.withColumn("_in", grounded_in(c("_e"), c(note)))
    lost = (
        F.when(~F.coalesce(c("new_prediction") == "Yes", F.lit(False)), F.lit(None)).when(~c("_in"), "UNGROUNDED").when(family & ~(P.has_any(c("_rel"), V.RELATION_TERMS) & P.has_any(c("_can"), V.CRC_TERMS)), "FAMILY_INCOMPLETE")
        .when(F.size(P.semantic_failures(c("feature"), c("_e"), c("_asr"), c("_exp"), c("_rel"), c("_can"))) > 0, "SEMANTIC")
    )
    d = d.withColumn("_lost", lost).withColumn("_no", (c("new_prediction") == "No") | c("_lost").isNotNull())
    r = {k: c(f"rescue_{k}") for k in ("evidence", *FIELDS)}
    safe = grounded_in(r["evidence"], c(note)) & (F.size(P.semantic_failures(c("feature"), r["evidence"], r["assertion_status"], r["experiencer"], r["relation_found"], r["cancer_type_found"])) == 0)
    d = d.withColumn("rescued", F.lit(rescue) & c("_open") & (c("prediction") == "Yes") & c("_no") & ~F.coalesce(c("rescue_used"), F.lit(False)) & F.coalesce(safe, F.lit(False)))
    gone = c("_lost").isNotNull()
    kept = F.when(gone | (c("_no") & ~c("_in")), "").otherwise(c("_e"))
    new = {
        "prediction": F.when(c("rescued") | ~c("_no"), "Yes").otherwise("No"), "evidence": F.when(c("rescued"), text(r["evidence"])).otherwise(kept),
        "note_section": F.when(c("rescued"), F.lower(text(r["note_section"]))).when(c("_no") & (c("_sec") == ""), "none").otherwise(c("_sec")),
        "experiencer": F.when(c("rescued"), F.lower(text(r["experiencer"]))).when(c("_lost").isin("FAMILY_INCOMPLETE", "SEMANTIC"), "").otherwise(c("_exp")),
        "assertion_status": F.when(c("rescued"), F.lower(text(r["assertion_status"]))).when(gone | (c("_no") & ~c("_asr").isin("negated", "absent", "historical", "unknown")), "absent").otherwise(c("_asr")),
        "relation_found": F.when(c("rescued"), F.lower(text(r["relation_found"]))).when(gone, "").otherwise(c("_rel")),
        "cancer_type_found": F.when(c("rescued"), F.lower(text(r["cancer_type_found"]))).when(gone, "").otherwise(c("_can")),
    }
    old = {"prediction": c("prediction"), "evidence": text(c("evidence_quote")), **{k: low(k) for k in FIELDS}}
    d = d.withColumns({f"corrected_{k}": F.when(c("_open"), v).otherwise(old[k]) for k, v in new.items()})
    metadata = F.lit(False)
    for k in FIELDS:
        metadata = metadata | (c(f"corrected_{k}") != old[k])
    kind = change_type(c("prediction"), c("corrected_prediction"), c("corrected_evidence") != old["evidence"], metadata, c("_error").isNotNull())
    d = d.withColumns({"change_type": F.when(c("verdict") == "VERIFIED", "UNCHANGED").otherwise(kind), "refined": c("_open"), "operational_error": c("_error").isNotNull(), "reason": F.coalesce(c("_error"), F.when(c("_open"), c("_lost")))})
    return d.drop("_error", "_open", "_e", "_sec", "_exp", "_asr", "_rel", "_can", "_in", "_lost", "_no")


def promote(df: DataFrame) -> DataFrame:
    """The claim after a refinement: the corrected label, evidence and fields, where it was refined without an error;
    confidence and inference stay, and claim_state_source says whose state it is."""
    took = F.col("refined") & ~F.col("operational_error")
    new = {"prediction": "corrected_prediction", "evidence_quote": "corrected_evidence", **{k: f"corrected_{k}" for k in FIELDS}}
    return df.withColumns({k: F.when(took, F.col(v)).otherwise(F.col(k)) for k, v in new.items()} | {"claim_state_source": F.when(took, "refiner").otherwise("original")})


def accept_retry(issues_before: Column, issues_after: Column, bleu_before: Column, bleu_after: Column, label_before: Column, label_after: Column, least: float = 0.10) -> Column:
    """Whether a retry is taken: metadata only if no issue is left, grounding if it is enough or better than before;
    neither may change the label."""
    same = label_before.eqNullSafe(label_after)
    return same & F.when(F.size(issues_before) > 0, F.size(issues_after) == 0).otherwise((F.coalesce(bleu_after, F.lit(0.0)) >= least) | (F.coalesce(bleu_after, F.lit(0.0)) > F.coalesce(bleu_before, F.lit(0.0))))


# The switches of the ablations.
SWITCHES = ("full", "no_final_judge", "no_refiner", "no_reverification", "no_clinical_validation", "no_negative_recovery", "developmental")
