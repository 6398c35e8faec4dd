"""Predicates of the diagnostic ontology and what follows from their class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
STRUCTURAL = ("configured_as", "controlled_by", "depends_on", "has_component", "installed_on", "located_in", "monitored_by", "part_of", "regulates")
CAUSAL = ("affects", "cascades_to", "caused_by", "contributes_to", "correlates_with", "has_symptom", "led_to", "suggests", "symptom_of", "triggers")
DIAGNOSTIC = (
    "alternative_to",
    "checked",
    "confirmed_by",
    "contradicts",
    "detected_by",
    "deviates_from",
    "drifts_from",
    "feedback_to",
    "found",
    "investigated_by",
    "investigates",
    "measured_as",
    "no_correlation",
    "normal",
    "observed_by",
    "preceded_by",
    "references",
    "refines_to",
    "repaired_by",
    "ruled_out",
    "supports",
)
STATE = ("deal_stage", "has_status")
OPPOSING = ("ruled_out",)
RELATIONAL_EXCLUSION = ("contradicts", "no_correlation")
GRAPH_EXCLUDED = (*OPPOSING, *RELATIONAL_EXCLUSION)
#: Predicates that hold one value where no vocabulary says so.
SINGLE_FALLBACK = ("deal_stage", "has_policy", "has_quota", "has_status", "renewed_arr", "valid_value")


def vocabulary() -> list[tuple[str, str]]:
    """(predicate, cardinality) of every predicate of the ontology, sorted."""
    return [(p, "single" if p in STATE else "multi") for p in sorted({*STRUCTURAL, *CAUSAL, *DIAGNOSTIC, *STATE})]


def graph_eligible() -> Column:
    """Whether a fact is an edge: positive, not excluded, and confirmed (causal) or observed or confirmed (others)."""
    p, s = F.col("predicate"), F.col("assertion_status")
    return (F.col("polarity") == "positive") & ~p.isin(*GRAPH_EXCLUDED) & F.when(p.isin(*CAUSAL), s == "confirmed").otherwise(s.isin("observed", "confirmed"))


def assertion(source: str = "source_text") -> tuple[Column, Column]:
    """(polarity, status) that an extracted statement gets from predicate, polarity, negation, assertion_status,
    evidence_span, trusted and the source text. The first rule that fits holds: opposing predicates are negative and
    ruled out; relational exclusions positive; causal ones ruled out if negative or rejected, confirmed if that was
    claimed with evidence that is trusted or stands in the source, else hypothesized; all others as claimed."""
    p, claimed = F.col("predicate"), F.col("assertion_status")
    polarity = F.when(F.coalesce("negation", F.lit(False)), "negative").otherwise(F.coalesce("polarity", F.lit("positive")))
    evidence = F.trim(F.coalesce("evidence_span", F.lit("")))
    grounded = F.coalesce("trusted", F.lit(False)) | F.coalesce(F.contains(F.col(source), evidence), F.lit(False))
    usual = F.coalesce(claimed, F.lit("observed"))
    causal = (
        F.when((polarity == "negative") | F.coalesce(claimed.isin("ruled_out", "rejected"), F.lit(False)), "ruled_out")
        .when((F.coalesce(claimed, F.lit("")) == "confirmed") & (evidence != "") & grounded, "confirmed")
        .otherwise("hypothesized")
    )
    signs = F.when(p.isin(*OPPOSING), "negative").when(p.isin(*RELATIONAL_EXCLUSION), "positive").otherwise(polarity)
    status = F.when(p.isin(*OPPOSING), "ruled_out").when(p.isin(*RELATIONAL_EXCLUSION), usual).when(p.isin(*CAUSAL), causal).otherwise(usual)
    return signs, status
