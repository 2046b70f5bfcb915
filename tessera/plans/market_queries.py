"""Queries over market bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import split_of
from tessera.functions.numbers import rounded as r
from tessera.operators import asof, bootstrap, market, quality, strategy
from tessera.plans import views as v
from tessera.plans.views import BARS, DATED, DISCOVERY_END, MAIN, MOMENTUM, RETURNS, SIGNALS, VALIDATION_END

_SPLIT = f"CASE WHEN trade_date <= DATE '{DISCOVERY_END}' THEN 'discovery' WHEN trade_date <= DATE '{VALIDATION_END}' THEN 'validation' ELSE 'oos' END"
_STRATEGIES = ["pure_trend", "blended", "additive", "confirm_only"]


def _parts(spark: SparkSession, sf_dir: str):
    b = v.bars(spark, sf_dir)
    m = market.main_continuous(b)
    return b, m, market.next_open_returns(m, b)


def main_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.main(spark, sf_dir).select("trade_date", "contract", "day_idx", "rolled", r(F.col("close")).alias("close"), "volume", "open_interest")


def roll_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = v.main(spark, sf_dir)
    return m.groupBy("contract").agg(F.count(F.lit(1)).alias("days"), F.count_if("rolled").alias("rolls"))


def next_open_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].select("day_idx", "signal_date", "trade_date", "contract", r(F.col("market_open_return")).alias("market_open_return"))


def same_contract_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, m, _ = _parts(spark, sf_dir)
    out = market.same_contract_momentum(m, b, [20, 60, 120])
    return out.select("day_idx", "trade_date", "contract", *[r(F.col(f"momentum_{h}d")).alias(f"momentum_{h}d") for h in (20, 60, 120)])


def _text_events(spark: SparkSession, sf_dir: str, m: DataFrame) -> DataFrame:
    gated = quality.gate(v.signals(spark, sf_dir), excluded_sources=["src0"]).filter("reject_reason IS NULL")
    return asof.on_calendar(gated, m.select("day_idx", "trade_date"), "publish_time").filter("day_idx IS NOT NULL")


_TREND = MOMENTUM + f""",
scale AS (SELECT CASE WHEN count(momentum_20d) >= 2 THEN stddev_pop(momentum_20d) END AS sd FROM momentum WHERE trade_date > DATE '{DISCOVERY_END}' AND trade_date <= DATE '{VALIDATION_END}'),
trend AS (SELECT day_idx, CASE WHEN sd > 0 THEN tanh(coalesce(momentum_20d, 0) / sd) ELSE 0 END AS trend_score FROM momentum, scale WHERE day_idx >= 20)"""

_GATED = SIGNALS.replace("flagged AS", "flagged AS", 1) + """,
gated AS (
  SELECT *, CASE WHEN source_name IS NULL THEN 'unmatched_text' WHEN NOT score > 0 THEN 'nonpositive' WHEN source_name = 'src0' THEN 'excluded_source'
                 WHEN NOT authoritative THEN 'quality_gate' WHEN NOT confidence > 0 THEN 'zero_confidence' END AS reject_reason FROM signals)"""

_TEXT = _TREND + ",\n" + _GATED + """,
placed AS (SELECT g.*, (SELECT min(day_idx) FROM main m WHERE m.trade_date >= g.publish_time) AS day_idx FROM gated g WHERE reject_reason IS NULL),
text_scores AS (
  SELECT m.day_idx, coalesce(sum(score * confidence * (5 - (m.day_idx - p.day_idx)) / 5) / nullif(sum(confidence * (5 - (m.day_idx - p.day_idx)) / 5), 0), 0) AS active_text_score
  FROM main m LEFT JOIN placed p ON p.day_idx BETWEEN m.day_idx - 4 AND m.day_idx GROUP BY 1)"""


def _scores(spark: SparkSession, sf_dir: str):
    """(day_idx, trend_score, active_text_score) of each day, and returns."""
    b, m, ret = _parts(spark, sf_dir)
    trend = strategy.trend_scores(market.same_contract_momentum(m, b, [20]), "1999-01-01", VALIDATION_END).filter("day_idx >= 20")
    text = strategy.decayed_text_scores(_text_events(spark, sf_dir, m), m)
    return trend.select("day_idx", "trend_score").join(text, "day_idx"), ret


def _positions(spark: SparkSession, sf_dir: str):
    b, m, ret = _parts(spark, sf_dir)
    momentum = market.same_contract_momentum(m, b, [20])
    trend = strategy.trend_scores(momentum, "1999-01-01", VALIDATION_END).filter("day_idx >= 20")
    text = strategy.decayed_text_scores(_text_events(spark, sf_dir, m), m)
    t, x = F.col("trend_score"), F.col("active_text_score")
    own = trend.join(text, "day_idx").select("day_idx", t.alias("pure_trend"), strategy.blend(t, x).alias("blended"), strategy.additive(t, x).alias("additive"), strategy.confirm_only(t, x).alias("confirm_only"))
    return own, ret


_ROWS = _TEXT + """,
positions AS (
  SELECT t.day_idx, unnest(['pure_trend', 'blended', 'additive', 'confirm_only']) AS strategy,
         unnest([trend_score, greatest(-1, least(1, 0.7 * trend_score + 0.3 * active_text_score)), greatest(-1, least(1, trend_score + 4.0 * active_text_score)),
                 CASE WHEN trend_score * active_text_score > 0 THEN greatest(-1, least(1, trend_score + 0.25 * active_text_score)) ELSE trend_score END]) AS position
  FROM trend t JOIN text_scores USING (day_idx)),
turned AS (
  SELECT p.*, signal_date, trade_date, market_open_return, abs(position - coalesce(lag(position) OVER (PARTITION BY strategy ORDER BY p.day_idx), 0)) AS turnover
  FROM positions p JOIN returns USING (day_idx)),
net AS (SELECT *, position * market_open_return - turnover * cost_bps / 10000 AS net_return FROM turned, (VALUES (2.0), (5.0), (10.0)) c(cost_bps)),
split_rows AS (SELECT *, """ + _SPLIT + """ AS split, product(1 + net_return) OVER (PARTITION BY strategy, cost_bps ORDER BY day_idx) AS nav FROM net)"""


def _rows(spark: SparkSession, sf_dir: str, costs: list[float] = [2.0, 5.0, 10.0]) -> DataFrame:
    own, ret = _positions(spark, sf_dir)
    return strategy.strategy_rows(own, ret, _STRATEGIES, costs).withColumn("split", split_of(F.col("trade_date"), DISCOVERY_END, VALIDATION_END))


def trend_position_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, [5.0])
    return rows.select("trade_date", "strategy", "split", r(F.col("position")).alias("position"), r(F.col("turnover")).alias("turnover"), r(F.col("net_return")).alias("net_return"), r(F.log("nav"), 4).alias("log_nav"))


_METRIC_COLUMNS = ("annual_return", "annual_volatility", "sharpe", "max_drawdown", "annual_turnover")


def strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strategy.strategy_metrics(_rows(spark, sf_dir, [5.0]), ["strategy", "split"])
    return out.select("strategy", "split", "observations", *[r(F.col(c), 5).alias(c) for c in _METRIC_COLUMNS])


def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strategy.strategy_metrics(_rows(spark, sf_dir), ["strategy", "cost_bps"])
    return out.select("strategy", "cost_bps", "observations", *[r(F.col(c), 5).alias(c) for c in _METRIC_COLUMNS])


def _metrics_sql(keys: str) -> str:
    return f""",
run AS (SELECT *, product(1 + net_return) OVER (PARTITION BY {keys} ORDER BY trade_date) AS own FROM split_rows),
fall AS (SELECT *, own / greatest(1, max(own) OVER (PARTITION BY {keys} ORDER BY trade_date)) - 1 AS f FROM run),
m AS (SELECT {keys}, count(*) AS observations, product(1 + net_return) AS total, stddev_pop(net_return) * sqrt(252) AS vol, least(0, min(f)) AS dd, sum(turnover) * 252 / count(*) AS turn FROM fall GROUP BY {keys})
SELECT {keys}, observations, round(CASE WHEN total > 0 THEN total ** (252 / observations) - 1 ELSE -1 END, 5) + 0.0 AS annual_return, round(CASE WHEN observations >= 2 THEN vol ELSE 0 END, 5) + 0.0 AS annual_volatility,
       round(CASE WHEN vol <> 0 THEN (CASE WHEN total > 0 THEN total ** (252 / observations) - 1 ELSE -1 END) / vol ELSE 0 END, 5) + 0.0 AS sharpe, round(dd, 5) + 0.0 AS max_drawdown, round(turn, 5) + 0.0 AS annual_turnover
FROM m"""


def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, [5.0])
    w = W.partitionBy("strategy").orderBy("day_idx").rowsBetween(W.unboundedPreceding, 0)
    fall = F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(w)) - 1
    return rows.withColumn("f", fall).groupBy("strategy").agg(r(F.min("f")).alias("max_drawdown"))


def _baseline(spark: SparkSession, sf_dir: str):
    b, m, ret = _parts(spark, sf_dir)
    return strategy.mature_baseline(market.same_contract_momentum(m, b, [20, 60, 120]), ret), m, ret


def _scale_sql(h: int) -> str:
    w = f"OVER (ORDER BY day_idx RANGE BETWEEN 126 PRECEDING AND 1 PRECEDING)"
    x = f"CASE WHEN day_idx >= {h} THEN momentum_{h}d END"
    return f"CASE WHEN count({x}) {w} >= 30 AND stddev_pop({x}) {w} > 0 THEN tanh(({x}) / stddev_pop({x}) {w}) END AS p{h}"


_BASELINE = MOMENTUM + f""",
parts AS (SELECT m.day_idx, m.trade_date AS signal_date, {_scale_sql(20)}, {_scale_sql(60)}, {_scale_sql(120)},
  count(s) OVER (ORDER BY m.day_idx RANGE BETWEEN 41 PRECEDING AND 2 PRECEDING) AS n, stddev_pop(s) OVER (ORDER BY m.day_idx RANGE BETWEEN 41 PRECEDING AND 2 PRECEDING) AS sd
  FROM (SELECT momentum.*, CASE WHEN momentum.day_idx >= 120 THEN market_open_return END AS s FROM momentum LEFT JOIN returns USING (day_idx)) m),
baseline AS (
  SELECT day_idx, signal_date, composite_momentum, realized_volatility, greatest(-1, least(1, composite_momentum * least(1, 0.25 / greatest(realized_volatility, 0.08)))) AS position
  FROM (SELECT *, (coalesce(p20, 0) + coalesce(p60, 0) + coalesce(p120, 0)) / nullif((p20 IS NOT NULL)::INT + (p60 IS NOT NULL)::INT + (p120 IS NOT NULL)::INT, 0) AS composite_momentum,
               CASE WHEN n >= 20 THEN sd * sqrt(252) ELSE 0.25 END AS realized_volatility FROM parts)
  WHERE day_idx >= 120 AND composite_momentum IS NOT NULL)"""


def mature_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = _baseline(spark, sf_dir)
    return out.select("day_idx", "signal_date", *[r(F.col(c)).alias(c) for c in ("composite_momentum", "realized_volatility", "position")])


def _overlay_rows(spark: SparkSession, sf_dir: str, weight: float, least: float) -> DataFrame:
    base, m, ret = _baseline(spark, sf_dir)
    gated = quality.gate(v.signals(spark, sf_dir), least=least, excluded_sources=["src0"], must_not="uncertainty_high" if least else None).filter("reject_reason IS NULL")
    text = strategy.decayed_text_scores(asof.on_calendar(gated, m.select("day_idx", "trade_date"), "publish_time").filter("day_idx IS NOT NULL"), m)
    own = base.join(text, "day_idx").select("day_idx", F.col("position").alias("baseline"), strategy.overlay(F.col("position"), F.col("active_text_score"), weight).alias("enhanced"))
    return strategy.strategy_rows(own, ret, ["baseline", "enhanced"], [5.0]).withColumn("split", split_of(F.col("trade_date"), DISCOVERY_END, VALIDATION_END))


def overlay_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _overlay_rows(spark, sf_dir, 0.25, 0.0)
    return rows.select("trade_date", "strategy", "split", r(F.col("position")).alias("position"), r(F.col("net_return")).alias("net_return"))


_OVERLAY = _BASELINE + ",\n" + _TEXT[len(_TREND) + 2 :] + """,
orows AS (
  SELECT day_idx, trade_date, strategy, position, market_open_return, abs(position - coalesce(lag(position) OVER (PARTITION BY strategy ORDER BY day_idx), 0)) AS turnover
  FROM (SELECT b.day_idx, unnest(['baseline', 'enhanced']) AS strategy,
               unnest([position, CASE WHEN position > 0 AND active_text_score > 0 THEN greatest(-1, least(1, position + 0.25 * active_text_score)) ELSE position END]) AS position
        FROM baseline b JOIN text_scores USING (day_idx)) JOIN returns USING (day_idx)),
onet AS (SELECT *, position * market_open_return - turnover * 5 / 10000 AS net_return, """ + _SPLIT + """ AS split FROM orows)"""


def pairwise_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _overlay_rows(spark, sf_dir, 0.25, 0.0)
    d = strategy.paired_differences(rows, "baseline", "enhanced", ["split", "trade_date"])
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("observations"), r(F.avg("difference") * 252).alias("annualized_difference"))


def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _overlay_rows(spark, sf_dir, 0.25, 0.0)
    d = strategy.paired_differences(rows, "baseline", "enhanced")
    return bootstrap.block_means(d, 63).select("trade_date", r(F.col("block_mean"), 8).alias("block_mean"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later overlay: a stricter gate and a larger weight."""
    return bootstrap.bootstrap(strategy.paired_differences(_overlay_rows(spark, sf_dir, 0.35, 0.2), "baseline", "enhanced"), samples=2000)


def quality_gate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gate_audit(quality.gate(v.signals(spark, sf_dir), excluded_sources=["src0"]))


def text_signal_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = v.main(spark, sf_dir).select("day_idx", "trade_date")
    return asof.on_calendar(v.dated(spark, sf_dir), m, "publish_time").select("doc_id", "publish_time", "trade_date", "day_idx")


def decayed_text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = v.main(spark, sf_dir)
    return strategy.decayed_text_scores(_text_events(spark, sf_dir, m), m).select("day_idx", r(F.col("active_text_score"), 9).alias("active_text_score"))


def forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, m, _ = _parts(spark, sf_dir)
    out = market.forward_labels(v.dated(spark, sf_dir), m, b)
    return out.select("doc_id", "entry_trade_date", "exit_trade_date", r(F.col("forward_open_return")).alias("forward_open_return"), "direction_label", "future_info_ok")


def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = v.main(spark, sf_dir).withColumn("split", split_of(F.col("trade_date"), DISCOVERY_END, VALIDATION_END))
    return m.groupBy("split").agg(F.count(F.lit(1)).alias("days"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


def settle_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions: written on their date, for the contract of their key."""
    b, m, _ = _parts(spark, sf_dir)
    contracts = F.array(*[F.lit(c) for c in ("AF", "NO", "RF")])
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("o_orderkey") % 2499).cast("int"))
    late = F.date_add(day, (F.col("o_orderkey") % 3).cast("int"))
    decisions = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"), day.alias("signal_date"), F.concat(late.cast("string"), F.lit("T16:00:00+08:00")).alias("recorded_at"), F.element_at(contracts, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("selected_contract"))
    return strategy.settle(decisions, m, b).select("decision_id", "settlement", r(F.col("market_open_return")).alias("market_open_return"))


QUERIES = {
    q.__name__: q
    for q in (
        main_continuous, roll_flags, next_open_return, same_contract_momentum, trend_position_nav, strategy_metrics, cost_sensitivity, max_drawdown, mature_baseline, overlay_strategy,
        pairwise_increment, block_means, bootstrap_ci, quality_gate_audit, text_signal_day, decayed_text_score, forward_label, split_labels, settle_ledger,
    )
}

#: Date columns of the results; queries return them as text, so that every engine shows them alike.
DATES = {
    "main_continuous": ["trade_date"], "next_open_return": ["signal_date", "trade_date"], "same_contract_momentum": ["trade_date"], "trend_position_nav": ["trade_date"], "mature_baseline": ["signal_date"],
    "overlay_strategy": ["trade_date"], "block_means": ["trade_date"], "text_signal_day": ["publish_time", "trade_date"], "forward_label": ["entry_trade_date", "exit_trade_date"], "split_labels": ["first_day", "last_day"],
}

SQL = {
    "main_continuous": f"WITH {MAIN} SELECT trade_date, contract, day_idx::INTEGER AS day_idx, rolled, round(close, 6) + 0.0 AS close, volume, open_interest FROM main",
    "roll_flags": f"WITH {MAIN} SELECT contract, count(*) AS days, count(*) FILTER (rolled) AS rolls FROM main GROUP BY contract",
    "next_open_return": f"WITH {RETURNS} SELECT day_idx::INTEGER AS day_idx, signal_date, trade_date, contract, round(market_open_return, 6) + 0.0 AS market_open_return FROM returns",
    "same_contract_momentum": f"WITH {MOMENTUM} SELECT day_idx::INTEGER AS day_idx, trade_date, contract, round(momentum_20d, 6) + 0.0 AS momentum_20d, round(momentum_60d, 6) + 0.0 AS momentum_60d, round(momentum_120d, 6) + 0.0 AS momentum_120d FROM momentum",
    "trend_position_nav": f"WITH {_ROWS} SELECT trade_date, strategy, split, round(position, 6) + 0.0 AS position, round(turnover, 6) + 0.0 AS turnover, round(net_return, 6) + 0.0 AS net_return, round(CASE WHEN nav > 0 THEN ln(nav) END, 4) + 0.0 AS log_nav FROM split_rows WHERE cost_bps = 5",
    "strategy_metrics": f"WITH {_ROWS.replace('(VALUES (2.0), (5.0), (10.0))', '(VALUES (5.0))')}{_metrics_sql('strategy, split')}",
    "cost_sensitivity": f"WITH {_ROWS}{_metrics_sql('strategy, cost_bps').replace('SELECT strategy, cost_bps, observations, round', 'SELECT strategy, cost_bps::DOUBLE AS cost_bps, observations, round')}",
    "max_drawdown": f"WITH {_ROWS}, f AS (SELECT strategy, nav / greatest(1, max(nav) OVER (PARTITION BY strategy ORDER BY day_idx)) - 1 AS f FROM split_rows WHERE cost_bps = 5) SELECT strategy, round(min(f), 6) + 0.0 AS max_drawdown FROM f GROUP BY strategy",
    "mature_baseline": f"WITH {_BASELINE} SELECT day_idx::INTEGER AS day_idx, signal_date, round(composite_momentum, 6) + 0.0 AS composite_momentum, round(realized_volatility, 6) + 0.0 AS realized_volatility, round(position, 6) + 0.0 AS position FROM baseline",
    "overlay_strategy": f"WITH {_OVERLAY} SELECT trade_date, strategy, split, round(position, 6) + 0.0 AS position, round(net_return, 6) + 0.0 AS net_return FROM onet",
    "pairwise_increment": f"WITH {_OVERLAY} SELECT split, count(*) AS observations, round(avg(e.net_return - b.net_return) * 252, 6) + 0.0 AS annualized_difference FROM onet b JOIN onet e USING (split, trade_date) WHERE b.strategy = 'baseline' AND e.strategy = 'enhanced' GROUP BY split",
    "block_means": f"WITH {_OVERLAY}, d AS (SELECT b.trade_date, e.net_return - b.net_return AS x FROM onet b JOIN onet e USING (trade_date) WHERE b.strategy = 'baseline' AND e.strategy = 'enhanced') SELECT trade_date, round(m, 8) + 0.0 AS block_mean FROM (SELECT trade_date, avg(x) OVER w AS m, count(x) OVER w AS n FROM d WINDOW w AS (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND 62 FOLLOWING)) WHERE n = 63",
    "quality_gate_audit": f"WITH {_GATED} SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n FROM gated GROUP BY 1",
    "text_signal_day": f"WITH {MAIN}, {DATED} SELECT d.doc_id, d.publish_time, m.trade_date, m.day_idx::INTEGER AS day_idx FROM dated d ASOF LEFT JOIN main m ON d.publish_time <= m.trade_date",
    "decayed_text_score": f"WITH {_TEXT} SELECT day_idx::INTEGER AS day_idx, round(active_text_score, 9) + 0.0 AS active_text_score FROM text_scores",
    "forward_label": f"""WITH {MAIN}, {DATED},
e AS (SELECT d.doc_id, d.publish_time, m.day_idx, m.trade_date AS entry FROM dated d ASOF JOIN main m ON d.publish_time < m.trade_date),
x AS (SELECT e.doc_id, e.publish_time, e.entry, h.trade_date AS leave, o.open / i.open - 1 AS ret
  FROM e JOIN main own ON own.day_idx = e.day_idx LEFT JOIN main known ON known.day_idx = e.day_idx - 1 JOIN main h ON h.day_idx = e.day_idx + 5
  JOIN bars i ON i.trade_date = e.entry AND i.contract = coalesce(known.contract, own.contract)
  JOIN bars o ON o.trade_date = h.trade_date AND o.contract = coalesce(known.contract, own.contract))
SELECT doc_id, entry AS entry_trade_date, leave AS exit_trade_date, round(ret, 6) + 0.0 AS forward_open_return,
       CASE WHEN ret >= 0.01 THEN 'bullish' WHEN ret <= -0.01 THEN 'bearish' ELSE 'neutral' END AS direction_label, entry > publish_time AS future_info_ok FROM x""",
    "split_labels": f"WITH {MAIN} SELECT {_SPLIT} AS split, count(*) AS days, min(trade_date) AS first_day, max(trade_date) AS last_day FROM main GROUP BY 1",
    "settle_ledger": f"""WITH {MAIN},
days AS (SELECT day_idx, trade_date AS signal_date, lead(trade_date, 1) OVER (ORDER BY day_idx) AS entry_date, lead(trade_date, 2) OVER (ORDER BY day_idx) AS exit_date FROM main),
dec AS (SELECT o_orderkey AS decision_id, (DATE '1995-01-02' + (o_orderkey % 2499)::INTEGER)::DATE AS signal_date, (DATE '1995-01-02' + (o_orderkey % 2499)::INTEGER + (o_orderkey % 3)::INTEGER)::DATE AS written, ['AF', 'NO', 'RF'][o_orderkey % 3 + 1] AS contract FROM orders),
x AS (SELECT d.decision_id, CASE WHEN s.day_idx IS NULL THEN 'signal_date_not_trading_day' WHEN s.entry_date IS NULL THEN 'entry_pending' WHEN d.written >= s.entry_date THEN 'recorded_after_entry_open'
    WHEN s.exit_date IS NULL THEN 'exit_pending' WHEN i.open IS NULL OR o.open IS NULL THEN 'contract_bar_missing' ELSE 'settled' END AS settlement, o.open / i.open - 1 AS ret
  FROM dec d LEFT JOIN days s USING (signal_date) LEFT JOIN bars i ON i.trade_date = s.entry_date AND i.contract = d.contract LEFT JOIN bars o ON o.trade_date = s.exit_date AND o.contract = d.contract)
SELECT decision_id, settlement, round(CASE WHEN settlement = 'settled' THEN ret END, 6) + 0.0 AS market_open_return FROM x""",
}
