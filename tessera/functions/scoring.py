"""Transparent scores of sources, evidence, rules and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import beta_posterior, bounded, clip, logistic, tri_state

#: Reliability of source types, and weights of an evidence score.
RELIABILITY = {"policy": 0.95, "announcement": 0.95, "ir_qa": 0.85, "news": 0.60}
DEFAULT_RELIABILITY, MAJOR_MEDIA_RELIABILITY = 0.60, 0.80
EVIDENCE_WEIGHTS = {"source_reliability": 0.30, "evidence_grounding": 0.25, "information_specificity": 0.25, "business_relevance": 0.20}


def source_reliability(kind: Column, name: Column, major_media: list[str]) -> Column:
    out = F.when((kind == "news") & name.isin(*major_media), MAJOR_MEDIA_RELIABILITY) if major_media else F.when(F.lit(False), 0.0)
    for k, v in RELIABILITY.items():
        out = out.when(kind == k, v)
    return out.otherwise(DEFAULT_RELIABILITY)


def evidence_score(reliability: Column, grounding: Column, specificity: Column, relevance: Column, second: dict[str, Column] | None = None) -> Column:
    """Weighted sum; a second annotator can only lower a component."""
    parts = {"evidence_grounding": grounding, "information_specificity": specificity, "business_relevance": relevance}
    total = EVIDENCE_WEIGHTS["source_reliability"] * reliability
    for name, own in parts.items():
        other = (second or {}).get(name)
        total = total + EVIDENCE_WEIGHTS[name] * (own if other is None else F.least(own, F.coalesce(bounded(other), own)))
    return total


def rule_score(positive: Column, support: Column, mean_return: Column, all_mean: Column, all_scale: Column, good_periods: Column, periods: Column, documents: Column, entities: Column, evidence: Column, terms: Column) -> Column:
    """Struct of a rule's components and its score in [0, 1]."""
    win = beta_posterior(positive, support)
    shrunk = support / (support + 10.0) * mean_return + 10.0 / (support + 10.0) * all_mean
    gain = logistic(shrunk, all_mean, F.abs(all_scale))
    stability = F.when(periods > 0, good_periods / periods).otherwise(0.0)
    coverage = 0.5 * F.least(documents / 20.0, F.lit(1.0)) + 0.5 * F.least(entities / 10.0, F.lit(1.0))
    penalty = 0.03 * F.greatest(terms - 1, F.lit(0))
    score = clip(0.30 * win + 0.25 * gain + 0.20 * stability + 0.15 * coverage + 0.10 * clip(evidence, 0.0, 1.0) - penalty, 0.0, 1.0)
    return F.struct(win.alias("posterior_win_rate"), shrunk.alias("shrunk_return"), gain.alias("return_component"), stability.alias("stability"), coverage.alias("coverage"), penalty.alias("complexity_penalty"), score.alias("score"))


def consensus_status(rule: Column, other: Column, tolerance: float = 0.10) -> Column:
    """agreed_true, agreed_false, disputed or invalid, of a rule's value and an annotator's (strings: true, false or a number)."""
    rule, other = F.lower(rule), F.lower(other)
    truth = rule.isin("true", "false")
    near = F.abs(other.try_cast("double") - rule.try_cast("double"))
    return (
        F.when(other.isNull() | (truth & ~other.isin("true", "false")), "invalid")
        .when(truth & (other == rule), F.when(rule == "true", "agreed_true").otherwise("agreed_false")).when(truth, "disputed")
        .when(near.isNull() | F.isnan(near), "invalid").when(near <= tolerance, "agreed_true").otherwise("disputed")
    )


def fused_value(rule: Column, other: Column, confidence: Column) -> Column:
    """The rule's value, drawn towards the annotator's by at most half, as far as the annotator is confident; the rule's alone without a valid second."""
    a, b = F.coalesce(tri_state(rule), F.lit(0.0)), tri_state(other)
    return F.when(b.isNull(), a).otherwise(clip(a + (b - a) * F.least(bounded(confidence), F.lit(0.5)), 0.0, 1.0))


def confidence_cap(completeness: Column, authoritative: Column, has_url: Column) -> Column:
    """Caps by completeness of the source text and by authority."""
    return (
        F.when(completeness == "full", F.when(authoritative, 0.95).otherwise(0.85))
        .when(~F.coalesce(has_url, F.lit(False)), 0.70).when(completeness == "failed", 0.60).otherwise(0.70)
    )
