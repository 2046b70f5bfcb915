"""Queries over grounded predicates, lagged rules and the monthly allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded as r
from tessera.operators import allocation, grounding, lagged_rules
from tessera.plans import views as v
from tessera.plans.views import BARS, DATED, TARGETS

#: Word groups for the given texts: licences, junk and prose of four languages.
PREDICATES = (
    grounding.Predicate("license_named", (("License", "Licensed", "CC BY"), ("Version", "version", "4.0", "MIT")), -1, 2),
    grounding.Predicate("junk_marks", (("###", "$$$"), ("%%%", "&&&")), -1, 1),
    grounding.Predicate("english_prose", ((" the ", "The "), (" of ", " and ")), 1, 1),
    grounding.Predicate("german_prose", ((" der ", " die "), (" und ", " ist ")), 1, 3),
)


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.ground(v.dated(spark, sf_dir, "text"), PREDICATES)


def grounded_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(spark, sf_dir).filter("value").select("doc_id", "name", "direction", r(F.col("intensity")).alias("intensity"), r(F.col("confidence")).alias("confidence"), "evidence_text")


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


def _evidence(p: grounding.Predicate) -> str:
    """The first sentence with a word of each group, else what surrounds the first word."""
    whole = " AND ".join(_any(g).replace("(text,", "(s,") for g in p.groups)
    word = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{w}'" for g in p.groups for w in g) + " END"
    return f"coalesce(substring(list_filter(sents, lambda s: {whole})[1], 1, 160), substring(text, greatest(strpos(text, {word}) - 40, 1), 160))"


_ROWS = ", ".join(f"CASE WHEN {' AND '.join(_any(g) for g in p.groups)} THEN {{'name': '{p.name}', 'direction': {p.direction}, 'lag': {p.lag}, 'evidence_text': {_evidence(p)}}} END" for p in PREDICATES)
_GROUNDED = f"""{DATED}, s AS (SELECT doc_id, publish_time, text, list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;])', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS sents FROM dated),
x AS (SELECT doc_id, publish_time, unnest([{_ROWS}]) AS p FROM s),
grounded AS (SELECT doc_id, CASE WHEN month(publish_time) <= 2 THEN last_day(make_date(year(publish_time), 2, 1)) ELSE last_day(publish_time) END AS period_end, p.name AS name, p.direction AS direction, p.lag AS lag, p.evidence_text AS evidence_text,
  0.55 + 0.15 + CASE WHEN length(p.evidence_text) >= 40 THEN 0.10 ELSE 0 END AS intensity, (0.45 + 0.35 * 0.6 + 0.15)::DOUBLE AS confidence FROM x WHERE p IS NOT NULL)"""


def lagged_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, support = lagged_rules.rule_signals(_grounded(spark, sf_dir), 2)
    out = lagged_rules.rule_quality(signals, support, v.targets(spark, sf_dir))
    return out.select(F.array_join("conditions", " AND ").alias("conditions"), "rule_lag", "support_documents", "support_periods", *[r(F.col(c), 5).alias(c) for c in ("correlation", "mae_gain", "year_stability")])


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.bars(spark, sf_dir)
    out = allocation.month_signals(b.filter("contract = 'NO'"), b.filter("contract = 'RF'"))
    return out.withColumn("acceleration", F.col("momentum_12m") - 0.005)


def monthly_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = allocation.allocate(_signals(spark, sf_dir), {"confirmed": "acceleration"}, (10.0,))
    return rows.select("month", "strategy", *[r(F.col(c)).alias(c) for c in ("risk_weight", "turnover", "net_return", "nav")])


def allocation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = allocation.allocate(_signals(spark, sf_dir), {"confirmed": "acceleration"})
    return allocation.monthly_metrics(rows, ["strategy", "cost_bps"]).select("strategy", "cost_bps", "months", *[r(F.col(c), 5).alias(c) for c in ("annual_return", "annual_volatility", "sharpe", "calmar", "max_drawdown", "monthly_win_rate", "annual_turnover", "worst_month")])


QUERIES = {"grounded_predicates": grounded_predicates, "lagged_rules": lagged_rules_query, "monthly_allocation": monthly_allocation, "allocation_metrics": allocation_metrics}
DATES = {"monthly_allocation": ["month"]}

_ALLOCATION = BARS + """,
risk AS (SELECT *, close / lag(close) OVER (ORDER BY trade_date) - 1 AS r FROM bars WHERE contract = 'NO'),
vol AS (SELECT *, stddev_pop(r) OVER w AS sd, count(r) OVER w AS n FROM risk WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
rm AS (SELECT date_trunc('month', trade_date)::DATE AS month, arg_max(close, trade_date) AS close, arg_max(sd, trade_date) AS sd, arg_max(n, trade_date) AS n, arg_min(open, trade_date) AS ro FROM vol GROUP BY 1),
dm AS (SELECT date_trunc('month', trade_date)::DATE AS month, arg_min(open, trade_date) AS dopen FROM bars WHERE contract = 'RF' GROUP BY 1),
s AS (SELECT month, close / lag(close, 12) OVER w - 1 AS mom, CASE WHEN n >= 2 THEN sd * sqrt(252) ELSE 0 END AS v, lead(ro, 2) OVER w / lead(ro, 1) OVER w - 1 AS rr, lead(dopen, 2) OVER w / lead(dopen, 1) OVER w - 1 AS dr FROM rm JOIN dm USING (month) WINDOW w AS (ORDER BY month)),
b AS (SELECT *, CASE WHEN mom > 0 AND v > 0 THEN least(0.10 / v, 1) ELSE 0 END AS w FROM s WHERE mom IS NOT NULL AND rr IS NOT NULL),
l AS (SELECT month, rr, dr, unnest(['buy_hold', 'trend', 'confirmed']) AS strategy, unnest([1.0::DOUBLE, w, CASE WHEN mom - 0.005 > 0 THEN w ELSE 0.5 * w END]) AS risk_weight FROM b),
t AS (SELECT *, abs(risk_weight - coalesce(lag(risk_weight) OVER (PARTITION BY strategy ORDER BY month), CASE WHEN strategy = 'buy_hold' THEN 1 ELSE 0 END)) AS turnover FROM l),
net AS (SELECT *, risk_weight * rr + (1 - risk_weight) * dr - turnover * cost_bps / 10000 AS net_return FROM t, (VALUES (5.0), (10.0), (20.0)) c(cost_bps)),
nav AS (SELECT *, product(1 + net_return) OVER (PARTITION BY strategy, cost_bps ORDER BY month) AS nav FROM net)"""

SQL = {
    "grounded_predicates": f"WITH {_GROUNDED} SELECT doc_id, name, direction::INTEGER AS direction, round(intensity, 6) + 0.0::DOUBLE AS intensity, round(confidence, 6) + 0.0 AS confidence, evidence_text FROM grounded",
    "lagged_rules": f"""WITH {_GROUNDED}, {TARGETS},
parts AS (SELECT doc_id, period_end, name AS conditions, direction, lag, confidence, abs(direction * intensity * confidence) AS strength FROM grounded
  UNION ALL SELECT a.doc_id, a.period_end, least(a.name, b.name) || ' AND ' || greatest(a.name, b.name), a.direction, a.lag, a.confidence, abs(a.direction * a.intensity * a.confidence) FROM grounded a JOIN grounded b ON a.doc_id = b.doc_id AND a.name <> b.name),
docs AS (SELECT conditions, doc_id, period_end, avg(strength) AS s, sum(direction) AS d FROM parts GROUP BY 1, 2, 3),
lags AS (SELECT conditions, round_even(quantile_cont(lag, 0.5), 0)::INTEGER AS rule_lag, sign(sum(direction)) AS expected, count(DISTINCT doc_id) AS support_documents, count(DISTINCT period_end) AS support_periods FROM parts GROUP BY 1),
source AS (SELECT conditions, period_end, avg(sign(d) * s) AS v FROM docs GROUP BY 1, 2),
moved AS (SELECT *, year(period_end) * 11 + greatest(month(period_end) - 2, 0) + rule_lag AS o FROM source JOIN lags USING (conditions)),
sig AS (SELECT conditions, last_day(make_date((o // 11)::BIGINT, (CASE WHEN o % 11 = 0 THEN 2 ELSE o % 11 + 2 END)::BIGINT, 1)) AS target_end, round(sum(v), 12) AS signal FROM moved GROUP BY 1, 2),
good AS (SELECT * FROM lags WHERE support_documents >= 12 AND support_periods >= 6),
met AS (SELECT conditions, expected, target_end, signal, release_date, actual FROM sig JOIN good USING (conditions) JOIN targets t ON t.period_end = target_end),
fits AS (SELECT conditions, CASE WHEN count(*) >= 3 AND var_pop(signal) > 0 AND var_pop(actual) > 0 THEN corr(signal, actual) ELSE 0 END AS correlation FROM met GROUP BY 1),
told AS (SELECT a.conditions, a.target_end, a.signal, a.actual, count(*) AS n, CASE WHEN var_pop(b.signal) > 0 THEN covar_pop(b.actual, b.signal) / var_pop(b.signal) ELSE 0 END AS slope, avg(b.actual) AS my, avg(b.signal) AS mx, arg_max(b.actual, b.release_date) AS last
  FROM met a JOIN met b ON a.conditions = b.conditions AND b.release_date <= a.target_end GROUP BY 1, 2, 3, 4),
gains AS (SELECT conditions, avg(abs(last - actual)) - avg(abs(my + slope * (signal - mx) - actual)) AS gain FROM told WHERE n >= 8 GROUP BY 1),
years AS (SELECT conditions, year(target_end) AS y, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(signal) > 0 AND var_pop(actual) > 0 THEN corr(signal, actual) ELSE 0 END * max(expected) > 0 AS ok FROM met GROUP BY 1, 2),
steady AS (SELECT conditions, avg(ok::INT) AS share FROM years WHERE n >= 3 GROUP BY 1)
SELECT conditions, rule_lag, support_documents, support_periods, round(coalesce(correlation, 0), 5) + 0.0::DOUBLE AS correlation, round(coalesce(gain, 0), 5) + 0.0 AS mae_gain, round(coalesce(share, 0), 5) + 0.0 AS year_stability
FROM good LEFT JOIN fits USING (conditions) LEFT JOIN gains USING (conditions) LEFT JOIN steady USING (conditions)""",
    "monthly_allocation": f"WITH {_ALLOCATION} SELECT month, strategy, round(risk_weight, 6) + 0.0 AS risk_weight, round(turnover, 6) + 0.0 AS turnover, round(net_return, 6) + 0.0 AS net_return, round(nav, 6) + 0.0 AS nav FROM nav WHERE cost_bps = 10",
    "allocation_metrics": f"""WITH {_ALLOCATION}, f AS (SELECT *, nav / max(nav) OVER (PARTITION BY strategy, cost_bps ORDER BY month) - 1 AS fall FROM nav),
m AS (SELECT strategy, cost_bps, count(*) AS months, product(1 + net_return) ** (12 / count(*)) - 1 AS ar, stddev_pop(net_return) * sqrt(12) AS av, min(fall) AS dd, avg((net_return > 0)::INT) AS win, sum(turnover) * 12 / count(*) AS turn, min(net_return) AS worst FROM f GROUP BY 1, 2)
SELECT strategy, cost_bps::DOUBLE AS cost_bps, months, round(ar, 5) + 0.0 AS annual_return, round(av, 5) + 0.0 AS annual_volatility, round(CASE WHEN av <> 0 THEN ar / av ELSE 0 END, 5) + 0.0 AS sharpe, round(CASE WHEN dd <> 0 THEN ar / abs(dd) ELSE 0 END, 5) + 0.0 AS calmar,
  round(dd, 5) + 0.0 AS max_drawdown, round(win, 5) + 0.0 AS monthly_win_rate, round(turn, 5) + 0.0 AS annual_turnover, round(worst, 5) + 0.0 AS worst_month FROM m""",
}
