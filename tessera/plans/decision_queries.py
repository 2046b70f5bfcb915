"""Decisions of three versions for every trading day, single forecasts mapped to positions, a ledger that takes them in, and the state of frozen tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded as r
from tessera.operators import asof, decisions, ledger, market, quality, strategy
from tessera.operators.decisions import Policy
from tessera.operators.iterate import saved
from tessera.plans import market_queries as mq
from tessera.plans import views as v

#: How each version adds text to its baseline, and by how much.
CONFIRMED, QUALITY, STRICT = Policy("confirmed-v2", "confirm", 1.0), Policy("quality-v5", "overlay", 0.25), Policy("quality-v6", "overlay", 0.35)
START, FROZEN = "1995-07-01", "1996-12-31"
NUDGE = 1e-9  # quarters of short decimals end on a five; so they round alike whatever the order of a sum
_MARKET = ["trade_date", "contract", "close_e4", "volume_"]
_SIGNAL = ["doc_id", "publish_time", "score_e2"]


def _trend(main: DataFrame, bars: DataFrame) -> DataFrame:
    scored = strategy.trend_scores(decisions.momentum_context(main, bars, [20]), "1999-01-01", v.VALIDATION_END)
    return scored.filter("day_idx >= 20")


def _made(spark: SparkSession, sf_dir: str, versions: tuple[Policy, ...]) -> DataFrame:
    """Decisions of some versions.  Days, and signals without their texts, are written once, as each version reads them several times."""
    b = v.bars(spark, sf_dir)
    m = saved(market.main_continuous(b))
    days = m.select("trade_date")
    signals = saved(asof.on_calendar(v.signals(spark, sf_dir), m.select("day_idx", "trade_date"), "publish_time"))
    whole = b.select("trade_date", "contract", F.floor(F.col("close") * 10000).alias("close_e4"), F.col("volume").cast("long").alias("volume_"))
    seen = signals.select("doc_id", "publish_time", F.floor(F.col("score") * 100 + 0.5).alias("score_e2"))
    digests = saved(decisions.prefix_digests(whole, "trade_date", _MARKET, days)), saved(decisions.prefix_digests(seen, "publish_time", _SIGNAL, days))
    gates = {QUALITY: {}, STRICT: {"least": 0.2, "must_not": "uncertainty_high"}}
    mature = saved(strategy.mature_baseline(market.same_contract_momentum(m, b, [20, 60, 120]), market.next_open_returns(m, b)).select("day_idx", "position")) if any(p in gates for p in versions) else None
    out = None
    for policy in versions:
        if policy in gates:
            baseline, kept = mature, quality.gate(signals, excluded_sources=["src0"], **gates[policy]).filter("reject_reason IS NULL")
        else:
            baseline, kept = _trend(m, b).select("day_idx", F.when(F.col("momentum_20d").isNotNull() & (F.col("validation_std") > 0), F.col("trend_score")).alias("position")), signals
        one = decisions.decisions(policy, m, baseline, kept.filter("day_idx IS NOT NULL"), *digests, start=START)
        out = one if out is None else out.unionByName(one)
    return out


def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir, (CONFIRMED, QUALITY, STRICT))
    numbers = [r(F.col(c) + NUDGE).alias(c) for c in ("baseline_position", "active_text_score", "enhanced_position", "position_delta")]
    return made.select("strategy_version", "signal_date", "status", "decision_id", "selected_contract", *numbers, "active_signals", "market_input_sha256", "signal_input_sha256")


def recorded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of one version sent to a ledger that holds every third day: replays, changed fields and second decisions come with them."""
    made = _made(spark, sf_dir, (CONFIRMED,)).filter("status = 'decided'").withColumn("recorded_at", F.concat(F.col("signal_date").cast("string"), F.lit("T16:00:00")))
    n = F.col("day_idx")
    held = made.filter(n % 3 == 0)
    sent = made.withColumn("selected_contract", F.when(n % 6 == 0, "XX").otherwise(F.col("selected_contract"))).withColumn("decision_id", F.when(n % 9 == 3, F.concat(F.lit("other"), n.cast("string"))).otherwise(F.col("decision_id")))
    late = made.filter(n % 5 == 1).withColumn("recorded_at", F.concat(F.col("signal_date").cast("string"), F.lit("T17:00:00")))
    out = decisions.recorded(held, sent.unionByName(late))
    return out.groupBy("outcome", F.array_join("changed_fields", ",").alias("changed_fields")).agg(F.count(F.lit(1)).alias("n"))


def mapped_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.bars(spark, sf_dir)
    m = market.main_continuous(b)
    forecasts = v.signals(spark, sf_dir).select("doc_id", "publish_time", "score")
    out = decisions.mapped_forecasts(forecasts, m, _trend(m, b))
    return out.select("doc_id", "status", "signal_market_date", "execution_trade_date", *[r(F.col(c)).alias(c) for c in ("baseline_position", "enhanced_position", "position_delta")], "text_confirmed_trend")


def system_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables frozen up to a day; since then labels of every hundredth document have changed, and later documents have come."""
    docs = v.dated(spark, sf_dir, "lang", "n_chars")
    labels = v.dated(spark, sf_dir).join(v.table(spark, sf_dir, "labels"), "doc_id")
    orders = v.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderstatus")
    was = ledger.freeze({"documents": (docs.filter(F.col("publish_time") <= F.lit(FROZEN).cast("date")), "publish_time"), "labels": (labels, "publish_time"), "orders": (orders, "o_orderdate")}, FROZEN)
    relabelled = labels.withColumn("toxic", F.when(F.col("doc_id") % 100 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    now = ledger.freeze({"documents": (docs, "publish_time"), "labels": (relabelled, "publish_time"), "orders": (orders, "o_orderdate")}, FROZEN)
    b = v.bars(spark, sf_dir)
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("o_orderkey") % 2499).cast("int"))
    taken = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"), day.alias("signal_date"), day.cast("string").alias("recorded_at"), F.lit("NO").alias("selected_contract"))
    return decisions.verification(was, now, strategy.settle(taken, market.main_continuous(b), b))


_POSITION = {"confirm": "CASE WHEN base * x > 0 THEN greatest(-1, least(1, base + {w} * x)) ELSE base END", "overlay": "CASE WHEN base > 0 AND x > 0 THEN greatest(-1, least(1, base + {w} * x)) ELSE base END"}


def _placed(name: str, condition: str) -> str:
    return f"""placed_{name} AS (SELECT g.doc_id, g.score, g.confidence, m.day_idx FROM (SELECT * FROM gated WHERE {condition}) g ASOF JOIN main m ON g.publish_time <= m.trade_date),
text_{name} AS (
  SELECT m.day_idx, coalesce(sum(score * confidence * (5 - (m.day_idx - p.day_idx)) / 5) / nullif(sum(confidence * (5 - (m.day_idx - p.day_idx)) / 5), 0), 0) AS x, count(p.doc_id) AS active_signals
  FROM main m LEFT JOIN placed_{name} p ON p.day_idx BETWEEN m.day_idx - 4 AND m.day_idx GROUP BY 1)"""


def _prefix(name: str, rows: str, day: str, columns: list[str]) -> str:
    line = " || ',' || ".join(f"""'"{c}":"' || {c} || '"'""" for c in columns)
    return f"""h_{name} AS (SELECT {day} AS day, sha256('{{' || {line} || '}}') AS h FROM ({rows})),
d_{name} AS (SELECT day, count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b FROM h_{name} GROUP BY 1),
p_{name} AS (SELECT m.trade_date, sha256(coalesce(sum(n), 0) || ':' || coalesce(sum(a), 0) || ':' || coalesce(sum(b), 0)) AS digest FROM main m LEFT JOIN d_{name} d ON d.day <= m.trade_date GROUP BY 1)"""


def _version(policy: Policy, base: str, text: str) -> str:
    return f"""SELECT '{policy.version}' AS strategy_version, m.day_idx, m.trade_date, m.contract, b.position AS base, x, active_signals, {_POSITION[policy.combine].format(w=policy.weight).replace('base', 'b.position')} AS enhanced
  FROM main m LEFT JOIN {base} b USING (day_idx) JOIN text_{text} USING (day_idx)"""


_IDENTITY = """'{"strategy_version":"' || strategy_version || '","signal_date":"' || v.trade_date || '","market_input_sha256":"' || pm.digest || '","signal_input_sha256":"' || ps.digest || '"}'"""
_MADE = f"""{mq._BASELINE}, {mq._TREND[len(v.MOMENTUM) + 2:]},
{mq._GATED},
known AS (SELECT t.day_idx, CASE WHEN momentum_20d IS NOT NULL AND sd > 0 THEN trend_score END AS position FROM trend t JOIN momentum USING (day_idx), scale),
{_placed('all', 'true')},
{_placed('good', 'reject_reason IS NULL')},
{_placed('strict', 'reject_reason IS NULL AND score >= 0.2 AND NOT uncertain')},
{_prefix('market', 'SELECT trade_date, contract, floor(close * 10000)::BIGINT AS close_e4, volume::BIGINT AS volume_ FROM bars', 'trade_date', _MARKET)},
{_prefix('signal', 'SELECT doc_id, publish_time, floor(score * 100 + 0.5)::BIGINT AS score_e2 FROM signals', 'publish_time', _SIGNAL)},
versions AS ({_version(CONFIRMED, 'known', 'all')} UNION ALL {_version(QUALITY, 'baseline', 'good')} UNION ALL {_version(STRICT, 'baseline', 'strict')}),
stated AS (SELECT *, CASE WHEN trade_date < DATE '{START}' THEN 'before_start' WHEN base IS NULL THEN 'no_baseline' ELSE 'decided' END AS status FROM versions),
made AS (SELECT v.*, pm.digest AS market_input_sha256, ps.digest AS signal_input_sha256, CASE WHEN status = 'decided' THEN substr(sha256({_IDENTITY}), 1, 24) END AS decision_id FROM stated v JOIN p_market pm USING (trade_date) JOIN p_signal ps USING (trade_date))"""

QUERIES = {q.__name__: q for q in (decision_records, recorded_decisions, mapped_forecasts, system_state)}
DATES = {"decision_records": ["signal_date"], "mapped_forecasts": ["signal_market_date", "execution_trade_date"]}
SQL = {
    "decision_records": f"""WITH {_MADE}
SELECT strategy_version, trade_date AS signal_date, status, decision_id, contract AS selected_contract, round(base + {NUDGE}, 6) + 0.0 AS baseline_position, round(x + {NUDGE}, 6) + 0.0 AS active_text_score, round(CASE WHEN status = 'decided' THEN enhanced END + {NUDGE}, 6) + 0.0 AS enhanced_position,
  round(CASE WHEN status = 'decided' THEN enhanced - base END + {NUDGE}, 6) + 0.0 AS position_delta, active_signals, market_input_sha256, signal_input_sha256 FROM made""",
    "recorded_decisions": f"""WITH {_MADE},
c AS (SELECT day_idx AS n FROM made WHERE strategy_version = '{CONFIRMED.version}' AND status = 'decided'),
first_sent AS (SELECT CASE WHEN n % 9 = 3 THEN 'second' WHEN n % 6 = 0 THEN 'changed' WHEN n % 3 = 0 THEN 'already_recorded' ELSE 'recorded' END AS outcome, n % 6 = 0 AS differs FROM c),
late AS (SELECT 'already_recorded' AS outcome, false AS differs FROM c WHERE n % 5 = 1)
SELECT outcome, CASE WHEN differs AND outcome <> 'second' THEN 'selected_contract' ELSE '' END AS changed_fields, count(*) AS n FROM (FROM first_sent UNION ALL FROM late) GROUP BY 1, 2""",
    "mapped_forecasts": f"""WITH {mq._TREND},
{mq._GATED},
ends AS (SELECT m.day_idx, m.trade_date, lead(m.trade_date) OVER (ORDER BY m.day_idx) AS following, momentum_20d, trend_score, sd FROM main m LEFT JOIN trend USING (day_idx) LEFT JOIN momentum USING (day_idx), scale),
p AS (SELECT s.doc_id, s.score, e.*, CASE WHEN e.day_idx IS NULL THEN 'awaiting_signal_day_market_data' WHEN e.day_idx < 20 OR e.momentum_20d IS NULL OR NOT coalesce(sd > 0, false) THEN 'insufficient_momentum_context' WHEN following IS NULL THEN 'awaiting_next_trading_day' ELSE 'mapped' END AS status
  FROM signals s ASOF LEFT JOIN ends e ON s.publish_time <= e.trade_date),
q AS (SELECT *, CASE WHEN status IN ('mapped', 'awaiting_next_trading_day') THEN trend_score END AS base FROM p),
z AS (SELECT *, CASE WHEN base * score > 0 THEN greatest(-1, least(1, base + score)) ELSE base END AS enhanced FROM q)
SELECT doc_id, status, trade_date AS signal_market_date, CASE WHEN day_idx >= 20 THEN following END AS execution_trade_date, round(base, 6) + 0.0 AS baseline_position, round(enhanced, 6) + 0.0 AS enhanced_position, round(enhanced - base, 6) + 0.0 AS position_delta, base * score > 0 AS text_confirmed_trend FROM z""",
    "system_state": f"""WITH {v.MAIN}, {v.DATED},
days AS (SELECT trade_date AS signal_date, lead(trade_date, 1) OVER (ORDER BY day_idx) AS e, lead(trade_date, 2) OVER (ORDER BY day_idx) AS x FROM main),
s AS (SELECT CASE WHEN days.signal_date IS NULL THEN 'signal_date_not_trading_day' WHEN e IS NULL THEN 'entry_pending' WHEN x IS NULL THEN 'exit_pending' WHEN i.open IS NULL OR o.open IS NULL THEN 'contract_bar_missing' ELSE 'settled' END AS t
  FROM (SELECT (DATE '1995-01-02' + (o_orderkey % 2499)::INTEGER)::DATE AS signal_date FROM orders) d LEFT JOIN days USING (signal_date) LEFT JOIN bars i ON i.trade_date = e AND i.contract = 'NO' LEFT JOIN bars o ON o.trade_date = x AND o.contract = 'NO'),
l AS (SELECT * FROM dated JOIN labels USING (doc_id) WHERE publish_time <= DATE '{FROZEN}')
SELECT 'frozen:documents' AS item, true AS ok, count(*) AS n FROM dated WHERE publish_time <= DATE '{FROZEN}'
UNION ALL SELECT 'frozen:labels', count(*) FILTER (doc_id % 100 = 0) = 0, count(*) FROM l
UNION ALL SELECT 'frozen:orders', true, count(*) FROM orders WHERE o_orderdate::DATE <= DATE '{FROZEN}'
UNION ALL SELECT 'decisions:recorded', true, count(*) FROM s UNION ALL SELECT 'decisions:settled', true, count(*) FROM s WHERE t = 'settled' UNION ALL SELECT 'decisions:pending', true, count(*) FROM s WHERE t LIKE '%_pending'
UNION ALL SELECT 'system', (SELECT count(*) FROM l WHERE doc_id % 100 = 0) = 0, 3""",
}
