"""Constraint and provenance checks that return every violation as a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``broken`` holds where a row violates the rule."""

    name: str
    broken: Column


def missing(column: str) -> Rule:
    return Rule(f"missing_{column}", F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == ""))


def not_in(column: str, values: list[str]) -> Rule:
    return Rule(f"invalid_{column}", ~F.col(column).isin(*values))


def not_like(column: str, pattern: str) -> Rule:
    return Rule(f"malformed_{column}", ~F.col(column).rlike(pattern))


def not_positive(column: str) -> Rule:
    return Rule(f"nonpositive_{column}", F.col(column) <= 0)


def negative(column: str) -> Rule:
    return Rule(f"negative_{column}", F.col(column) < 0)


def bar_order() -> Rule:
    return Rule("ohlc_order", (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")))


def violations(df: DataFrame, key: list[str], rules: list[Rule], unique: bool = True, ascending: tuple[list[str], str, str] | None = None) -> DataFrame:
    """(key..., violation): one row for each rule that a row breaks, for each row of a repeated key, and for rows that step back.

    ``ascending``: group columns, line-number column and the column that must not decrease within a group.
    """
    checks = [F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules]
    out = df
    if unique:
        out = out.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*key)))
        checks.append(F.when(F.col("__n") > 1, F.lit("duplicate_key")))
    if ascending:
        groups, line, column = ascending
        out = out.withColumn("__before", F.lag(column).over(W.partitionBy(*groups).orderBy(line)))
        checks.append(F.when(F.col("__before") > F.col(column), F.lit(f"descending_{column}")))
    return out.select(*key, F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def provenance(texts: DataFrame, audit: DataFrame, text: str = "content", key: str = "doc_id") -> DataFrame:
    """(key, problem): documents without or with several audit rows, or whose digest, length or link differ, and audit rows without document."""
    number = audit.groupBy(key).agg(F.count(F.lit(1)).alias("__audits"), *[F.first(c).alias(f"__{c}") for c in ("content_sha256", "original_chars", "url")])
    met = texts.join(number, key, "left")
    problems = F.array_compact(F.array(
        F.when(F.col("__audits").isNull(), "no_audit_row"), F.when(F.col("__audits") > 1, "repeated_audit_row"),
        F.when(F.col("__content_sha256") != F.sha2(F.coalesce(text, F.lit("")), 256), "content_changed"),
        F.when(F.col("__original_chars") < F.length(text), "longer_than_original"), F.when(~F.col("url").eqNullSafe(F.col("__url")) & F.col("__audits").isNotNull(), "url_differs"),
    ))
    orphans = audit.join(texts.select(key).distinct(), key, "left_anti").select(key, F.lit("orphan_audit_row").alias("problem"))
    return met.select(key, F.explode(problems).alias("problem")).unionByName(orphans)


def stable_status(status: Column, marker: str = "reused_audited_corpus") -> Column:
    """A fetch status without its nested reuse prefixes."""
    return F.regexp_replace(status, f"^({marker}:)+", "")


def gate(signals: DataFrame, score: str = "score", confidence: str = "confidence", least: float = 0.0, excluded_sources: list[str] = [], agreed: str = "agreed", must: str = "authoritative_source", must_not: str | None = None) -> DataFrame:
    """Add reject_reason: the first ground, in this order, on which a signal isn't taken; null for accepted ones."""
    positive = F.col(score) > 0 if least <= 0 else F.col(score) >= least
    out = (
        F.when(F.col("source_name").isNull(), "unmatched_text").when(~F.coalesce(positive, F.lit(False)), "nonpositive")
        .when(F.col("source_name").isin(*excluded_sources) if excluded_sources else F.lit(False), "excluded_source")
        .when(~F.array_contains(agreed, must), "quality_gate")
    )
    if must_not:
        out = out.when(F.array_contains(agreed, must_not), "uncertain")
    return signals.withColumn("reject_reason", out.when(~F.coalesce(F.col(confidence) > 0, F.lit(False)), "zero_confidence"))


def gate_audit(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
