"""Queries over rules, factors and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import season
from tessera.functions.numbers import beta_posterior, correlation_or_zero
from tessera.functions.numbers import rounded as r
from tessera.operators import asof, factors, models, rules
from tessera.plans import views as v
from tessera.plans.views import DATED, ENTITY_BARS, FLAGGED, RECORDS, TARGETS


def _rule_text(df: DataFrame) -> DataFrame:
    return df.withColumn("conditions", F.array_join("conditions", " AND "))


def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.rule_coverage(v.records(spark, sf_dir), ["bullish", "bearish"])
    return _rule_text(out).select("conditions", "target_label", r(F.col("coverage_positive")).alias("coverage_positive"), r(F.col("coverage_negative")).alias("coverage_negative"), "support_documents", "support_dates")


_COMBOS = RECORDS + """,
one AS (SELECT doc_id, publish_time, direction_label, unnest(names) AS a FROM records),
combos AS (SELECT doc_id, publish_time, direction_label, a AS conditions, 1 AS n FROM one
           UNION ALL SELECT x.doc_id, x.publish_time, x.direction_label, x.a || ' AND ' || y.a, 2 FROM one x JOIN one y ON x.doc_id = y.doc_id AND x.a < y.a),
totals AS (SELECT target_label, count(*) FILTER (direction_label = target_label) AS p, count(*) AS everything FROM records, (VALUES ('bullish'), ('bearish')) t(target_label) GROUP BY 1),
cover AS (SELECT conditions, any_value(c.n) AS n, target_label, count(*) FILTER (direction_label = target_label) / any_value(p) AS coverage_positive, count(*) FILTER (direction_label <> target_label) / any_value(everything - p) AS coverage_negative,
                 count(DISTINCT doc_id) AS support_documents, count(DISTINCT publish_time) AS support_dates FROM combos c, totals GROUP BY conditions, target_label)"""


def rulebook_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_text(rules.induce_rulebook(v.records(spark, sf_dir))).select("target_label", F.col("rank").cast("int").alias("rank"), "conditions", r(F.col("score")).alias("score"), "support_documents")


_BOOK = _COMBOS + """,
book AS (SELECT *, row_number() OVER (PARTITION BY target_label ORDER BY score DESC, n, support_documents DESC, string_split(conditions, ' AND ')) AS rank
         FROM (SELECT *, coverage_positive - coverage_negative AS score FROM cover) WHERE score > 0 AND support_documents >= 5 AND support_dates >= 3),
top_rules AS (SELECT * FROM book WHERE rank <= 5)"""


def rule_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = v.records(spark, sf_dir)
    out = rules.rule_stability(rec, rules.induce_rulebook(rec))
    return _rule_text(out).select("conditions", "target_label", "half", r(F.col("half_score")).alias("half_score"), "half_support")


def stable_rulebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = v.records(spark, sf_dir)
    book = rules.induce_rulebook(rec)
    return _rule_text(rules.stable_rules(book, rules.rule_stability(rec, book), rec, ["1995H1", "1995H2"], 1)).select("target_label", "conditions", "covered")


def impact_prior_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as event types; a document moves by its place among its source's lengths."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("event_type"), (((F.col("n_chars") % 100) - 50) / 1000.0).alias("excess"))
    return factors.impact_priors(docs).select("event_type", "document_count", "hit_count", r(F.col("posterior")).alias("posterior"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in v.FLAGS]))
    return v.flagged(spark, sf_dir, "source", "n_chars").select(F.col("doc_id").alias("event_id"), (F.col("doc_id") - F.col("doc_id") % 2).alias("doc_id"), F.col("source").alias("entity"), F.col("publish_time").alias("event_time"), names.alias("names"), (((F.col("n_chars") % 100) - 45) / 1000.0).alias("excess"), ((F.col("n_chars") % 7) / 7.0).alias("evidence"))


def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.return_rules(_events(spark, sf_dir))
    return _rule_text(out).select("conditions", "support_count", "positive_count", "entity_count", "period_count", r(F.col("avg_return")).alias("avg_return"), r(F.col("components.shrunk_return")).alias("shrunk_return"), r(F.col("score"), 5).alias("score"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.forward_returns(v.entity_bars(spark, sf_dir), 2)


_FORWARD = ENTITY_BARS + ",\nf AS (SELECT *, lead(close, 1) OVER (PARTITION BY entity ORDER BY trade_date) / open - 1 AS ret FROM ebars)"


def sector_excess_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = factors.excess_over(_entities(spark, sf_dir).filter("forward_return_2d IS NOT NULL"), "forward_return_2d", ["trade_date", "sector"])
    return out.select("trade_date", "entity", r(F.col("excess")).alias("excess"))


def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.rank_correlation(_entities(spark, sf_dir), "factor", "forward_return_2d", ["trade_date"]).select("trade_date", "n", r(F.col("rank_ic")).alias("rank_ic"))


_IC = _FORWARD + """,
good AS (SELECT * FROM f WHERE factor IS NOT NULL AND ret IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY factor) + (count(*) OVER (PARTITION BY trade_date, factor) - 1) / 2 AS rx, rank() OVER (PARTITION BY trade_date ORDER BY ret) + (count(*) OVER (PARTITION BY trade_date, ret) - 1) / 2 AS ry FROM good),
ic AS (SELECT trade_date, count(*) AS n, corr(rx, ry) AS rank_ic FROM ranked GROUP BY 1 HAVING count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0)"""


def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = factors.rank_correlation(_entities(spark, sf_dir), "factor", "forward_return_2d", ["trade_date"])
    return factors.ic_summary(ic).select("dates", *[r(F.col(c)).alias(c) for c in ("rank_ic_mean", "ic_ir", "positive_share")])


def quintile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = factors.group_returns(_entities(spark, sf_dir).filter("forward_return_2d IS NOT NULL"), "factor", "forward_return_2d", ["trade_date"])
    return out.select("bucket", r(F.col("mean_return")).alias("mean_return"), "n")


def sector_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.entity_bars(spark, sf_dir).select("trade_date", "entity", r(factors.z_score("factor", ["trade_date", "sector"])).alias("z"))


def recency_decay_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = v.entity_bars(spark, sf_dir).withColumn("factor_value", F.col("factor"))
    out = factors.snapshot(own, "1999-12-31")
    return out.select("entity", "sector", "events", r(F.col("raw_score")).alias("raw_score"), r(F.col("score_z")).alias("score_z"))


def event_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as events of a supplier."""
    bars = v.entity_bars(spark, sf_dir)
    events = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 10 + 1).alias("entity"), F.col("o_orderdate").cast("date").alias("event_time"))
    out = factors.event_returns(events, bars, (2, 4))
    return out.select("event_id", "entity", "entry_trade_date", r(F.col("forward_return_2d")).alias("forward_return_2d"), r(F.col("forward_return_4d")).alias("forward_return_4d"))


def factor_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).groupBy("sector").agg(r(correlation_or_zero(F.col("factor"), F.col("forward_return_2d"))).alias("correlation"))


def posterior_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = v.records(spark, sf_dir)
    each = rec.select(F.explode("names").alias("name"), (F.col("direction_label") == "bearish").alias("hit"))
    return each.groupBy("name").agg(r(beta_posterior(F.count_if("hit"), F.count(F.lit(1)))).alias("posterior"))


def asof_latest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the latest target released by its day."""
    docs = v.dated(spark, sf_dir).select("doc_id", F.col("publish_time").alias("as_of"))
    return asof.latest_released(v.targets(spark, sf_dir), docs).select("doc_id", r(F.col("actual")).alias("actual"), "period_end")


def document_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.containing_period(v.dated(spark, sf_dir), v.targets(spark, sf_dir), "publish_time")
    return out.select("doc_id", "period_start", "period_end")


def expanding_train_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.released_history(v.targets(spark, sf_dir))
    return out.select("period_end", "n_known", r(F.col("known_mean")).alias("known_mean"), r(F.col("known_last")).alias("known_last"))


def seasonal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.seasonal_mean(v.targets(spark, sf_dir), 2).select("period_end", r(F.col("seasonal_mean")).alias("seasonal_mean"))


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR(1) by expanding lines against persistence."""
    from pyspark.sql import Window as W

    w = W.orderBy("period_end")
    lagged = v.targets(spark, sf_dir).withColumn("base", F.lag("actual").over(w)).filter("base IS NOT NULL")
    return models.expanding_line(lagged, "base", "actual", "period_end", least=6).withColumn("forecast", F.col("fit"))


_AR = TARGETS + """,
lagged AS (SELECT *, lag(actual) OVER (ORDER BY period_end) AS base FROM targets),
ar AS (SELECT *, CASE WHEN regr_count(actual, base) OVER w >= 6 THEN regr_intercept(actual, base) OVER w + regr_slope(actual, base) OVER w * base END AS forecast
       FROM (SELECT * FROM lagged WHERE base IS NOT NULL) WINDOW w AS (ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def expanding_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecasts(spark, sf_dir).select("period_end", r(F.col("forecast"), 4).alias("forecast"))


def forecast_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.forecast_errors(_forecasts(spark, sf_dir).withColumn("year", F.year("period_end")), ["year"])
    return out.select("year", "n", *[r(F.col(c), 4).alias(c) for c in ("mae", "rmse", "r2_vs_base", "direction_accuracy")])


def interval_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _forecasts(spark, sf_dir).filter("forecast IS NOT NULL").withColumn("error", F.col("actual") - F.col("forecast"))
    return models.interval_width(errors).select("period_end", r(F.col("width"), 4).alias("width"))


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = v.table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), (F.col("l_extendedprice") / 1000).alias("y"), F.month("l_shipdate").alias("month"))


def ridge_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.gram(_design(spark, sf_dir), ["q", "d", "t"], "y").select("i", "j", r(F.col("value"), 2).alias("value"))


def ridge_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prediction of a ridge and of an elastic net for each month of shipping."""
    df = _design(spark, sf_dir)
    ridge, net = models.ridge(df, ["q", "d", "t"], "y", 10.0), models.elastic_net(df, ["q", "d", "t"], "y", 0.1, 0.5)
    out = df.groupBy("month").agg(F.avg(ridge.predict(3.0)).alias("ridge"), F.avg(net.predict()).alias("net"), F.avg("y").alias("actual"))
    return out.select("month", *[r(F.col(c), 4).alias(c) for c in ("ridge", "net", "actual")])


def seasonal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = season(F.col("period_end"))
    return v.targets(spark, sf_dir).select("period_end", r(s).alias("season_sin"), r(c).alias("season_cos"))


QUERIES = {
    q.__name__: q
    for q in (
        rule_coverage, rulebook_topk, rule_stability, stable_rulebook, impact_prior_beta, rule_score, sector_excess_return, rank_ic, ic_summary, quintile_returns, sector_zscore, recency_decay_snapshot, event_forward_returns,
        factor_correlation, posterior_by_flag, asof_latest_release, document_period, expanding_train_counts, seasonal_means, expanding_ar, forecast_errors, interval_widths, ridge_gram, ridge_forecast, seasonal_terms,
    )
}

DATES = {
    "sector_excess_return": ["trade_date"], "rank_ic": ["trade_date"], "sector_zscore": ["trade_date"], "event_forward_returns": ["entry_trade_date"], "asof_latest_release": ["period_end"], "document_period": ["period_start", "period_end"],
    "expanding_train_counts": ["period_end"], "seasonal_means": ["period_end"], "expanding_ar": ["period_end"], "interval_widths": ["period_end"], "seasonal_terms": ["period_end"],
}

_PAIRS = [(a, b) for i, a in enumerate(["1", "q", "d", "t", "y"]) for b in ["1", "q", "d", "t", "y"][i:]]

SQL = {
    "rule_coverage": f"WITH {_COMBOS} SELECT conditions, target_label, round(coverage_positive, 6) + 0.0 AS coverage_positive, round(coverage_negative, 6) + 0.0 AS coverage_negative, support_documents, support_dates FROM cover",
    "rulebook_topk": f"WITH {_BOOK} SELECT target_label, rank::INTEGER AS rank, conditions, round(score, 6) + 0.0 AS score, support_documents FROM top_rules",
    "rule_stability": f"""WITH {_BOOK}, h AS (SELECT t.conditions, t.target_label, year(publish_time) || CASE WHEN month(publish_time) <= 6 THEN 'H1' ELSE 'H2' END AS half, direction_label = t.target_label AS pos, list_has_all(names, string_split(t.conditions, ' AND ')) AS hit FROM records, top_rules t)
SELECT conditions, target_label, half, round(coalesce(count(*) FILTER (hit AND pos) / nullif(count(*) FILTER (pos), 0), 0) - coalesce(count(*) FILTER (hit AND NOT pos) / nullif(count(*) FILTER (NOT pos), 0), 0), 6) + 0.0 AS half_score, count(*) FILTER (hit) AS half_support FROM h GROUP BY 1, 2, 3""",
    "impact_prior_beta": "WITH x AS (SELECT source AS event_type, abs(((n_chars % 100) - 50) / 1000.0) >= 0.02 AS hit FROM documents) SELECT event_type, count(*) AS document_count, count(*) FILTER (hit) AS hit_count, round((count(*) FILTER (hit) + 2) / (count(*) + 4), 6) + 0.0 AS posterior FROM x GROUP BY 1",
    "rule_score": f"""WITH {FLAGGED},
ev AS (SELECT doc_id AS event_id, doc_id - doc_id % 2 AS doc_id, source AS entity, publish_time AS event_time, list_sort(list_filter([{', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in v.FLAGS)}], lambda x: x IS NOT NULL)) AS names, ((n_chars % 100) - 45) / 1000.0 AS excess, (n_chars % 7) / 7.0 AS evidence FROM flagged),
docs AS (SELECT avg(excess) AS r FROM ev GROUP BY doc_id), whole AS (SELECT avg(r) AS m, stddev_pop(r) AS s FROM docs),
one AS (SELECT ev.*, unnest(names) AS a FROM ev),
two AS (SELECT x.*, y.a AS b FROM one x JOIN one y ON x.event_id = y.event_id AND x.a < y.a),
combos AS (SELECT doc_id, entity, event_time, excess, evidence, a || ' AND ' || b AS conditions, 2 AS terms FROM two
  UNION ALL SELECT x.doc_id, x.entity, x.event_time, x.excess, x.evidence, x.a || ' AND ' || x.b || ' AND ' || y.a, 3 FROM two x JOIN one y ON x.event_id = y.event_id AND x.b < y.a),
bd AS (SELECT conditions, any_value(terms) AS terms, doc_id, avg(excess) AS r, avg(evidence) AS e, max(year(event_time) || CASE WHEN month(event_time) <= 6 THEN 'H1' ELSE 'H2' END) AS half FROM combos GROUP BY conditions, doc_id),
mm AS (SELECT conditions, any_value(terms) AS terms, count(*) AS support_count, count(*) FILTER (r > 0) AS positive_count, avg(r) AS avg_return, avg(e) AS ev FROM bd GROUP BY 1),
hh AS (SELECT conditions, count(*) AS period_count, count(*) FILTER (m > 0) AS good FROM (SELECT conditions, half, avg(r) AS m FROM bd GROUP BY 1, 2) GROUP BY 1),
bb AS (SELECT conditions, count(DISTINCT entity) AS entity_count FROM combos GROUP BY 1),
x AS (SELECT *, support_count / (support_count + 10.0) * avg_return + 10.0 / (support_count + 10.0) * m AS shrunk FROM mm JOIN hh USING (conditions) JOIN bb USING (conditions), whole WHERE support_count >= 3)
SELECT conditions, support_count, positive_count, entity_count, period_count, round(avg_return, 6) + 0.0 AS avg_return, round(shrunk, 6) + 0.0 AS shrunk_return,
  round(greatest(0, least(1, 0.30 * (positive_count + 2) / (support_count + 4) + 0.25 / (1 + exp(-greatest(-40, least(40, (shrunk - m) / greatest(s, 0.0025))))) + 0.20 * good / period_count
    + 0.15 * (0.5 * least(support_count / 20.0, 1) + 0.5 * least(entity_count / 10.0, 1)) + 0.10 * ev - 0.03 * (terms - 1))), 5) + 0.0 AS score FROM x""",
    "sector_excess_return": f"WITH {_FORWARD} SELECT trade_date, entity, round(ret - avg(ret) OVER (PARTITION BY trade_date, sector), 6) + 0.0 AS excess FROM f WHERE ret IS NOT NULL",
    "rank_ic": f"WITH {_IC} SELECT trade_date, n, round(rank_ic, 6) + 0.0 AS rank_ic FROM ic",
    "ic_summary": f"WITH {_IC} SELECT count(*) AS dates, round(avg(rank_ic), 6) + 0.0 AS rank_ic_mean, round(avg(rank_ic) / stddev_pop(rank_ic), 6) + 0.0 AS ic_ir, round(avg((rank_ic > 0)::INT), 6) + 0.0 AS positive_share FROM ic",
    "quintile_returns": f"WITH {_IC}, b AS (SELECT ret, least(5, floor((rx - 1) * 5 / count(*) OVER (PARTITION BY trade_date)) + 1)::INTEGER AS bucket FROM ranked) SELECT bucket, round(avg(ret), 6) + 0.0 AS mean_return, count(*) AS n FROM b GROUP BY 1",
    "sector_zscore": f"WITH {ENTITY_BARS} SELECT trade_date, entity, round(CASE WHEN stddev_pop(factor) OVER w > 0 THEN (factor - avg(factor) OVER w) / stddev_pop(factor) OVER w ELSE 0 END, 6) + 0.0 AS z FROM ebars WINDOW w AS (PARTITION BY trade_date, sector)",
    "recency_decay_snapshot": f"WITH {ENTITY_BARS}, s AS (SELECT entity, sector, count(*) AS events, sum(factor * 0.5 ** (date_diff('day', trade_date, DATE '1999-12-31') / 45)) AS raw FROM ebars WHERE trade_date <= DATE '1999-12-31' GROUP BY 1, 2) SELECT entity, sector, events, round(raw, 6) + 0.0 AS raw_score, round(CASE WHEN stddev_pop(raw) OVER w > 0 THEN (raw - avg(raw) OVER w) / stddev_pop(raw) OVER w ELSE 0 END, 6) + 0.0 AS score_z FROM s WINDOW w AS (PARTITION BY sector)",
    "event_forward_returns": f"""WITH {ENTITY_BARS}, a AS (SELECT entity, trade_date, open, lead(close, 1) OVER w AS c2, lead(close, 3) OVER w AS c4 FROM ebars WINDOW w AS (PARTITION BY entity ORDER BY trade_date)),
e AS (SELECT o_orderkey AS event_id, o_custkey % 10 + 1 AS entity, o_orderdate::DATE AS event_time FROM orders)
SELECT event_id, e.entity, a.trade_date AS entry_trade_date, round(c2 / open - 1, 6) + 0.0 AS forward_return_2d, round(c4 / open - 1, 6) + 0.0 AS forward_return_4d FROM e ASOF JOIN a ON e.entity = a.entity AND e.event_time < a.trade_date WHERE c4 IS NOT NULL""",
    "factor_correlation": f"WITH {_FORWARD} SELECT sector, round(corr(factor, ret), 6) + 0.0 AS correlation FROM f WHERE ret IS NOT NULL GROUP BY 1",
    "posterior_by_flag": f"WITH {RECORDS}, x AS (SELECT unnest(names) AS name, direction_label = 'bearish' AS hit FROM records) SELECT name, round((count(*) FILTER (hit) + 2) / (count(*) + 4), 6) + 0.0 AS posterior FROM x GROUP BY 1",
    "asof_latest_release": f"WITH {DATED}, {TARGETS} SELECT doc_id, round(actual, 6) + 0.0 AS actual, period_end FROM dated d ASOF LEFT JOIN targets t ON d.publish_time >= t.release_date",
    "document_period": f"WITH {DATED}, {TARGETS} SELECT doc_id, period_start, period_end FROM dated LEFT JOIN targets ON publish_time BETWEEN period_start AND period_end",
    "expanding_train_counts": f"WITH {TARGETS} SELECT a.period_end, count(b.actual) AS n_known, round(avg(b.actual), 6) + 0.0 AS known_mean, round(arg_max(b.actual, b.release_date), 6) + 0.0 AS known_last FROM targets a LEFT JOIN targets b ON b.release_date <= a.period_end GROUP BY 1",
    "seasonal_means": f"WITH {TARGETS} SELECT period_end, round(avg(actual) OVER (PARTITION BY month(period_end) ORDER BY period_end ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 6) + 0.0 AS seasonal_mean FROM targets",
    "expanding_ar": f"WITH {_AR} SELECT period_end, round(forecast, 4) + 0.0 AS forecast FROM ar",
    "forecast_errors": f"WITH {_AR} SELECT year(period_end)::INTEGER AS year, count(*) AS n, round(avg(abs(actual - forecast)), 4) + 0.0 AS mae, round(sqrt(avg((actual - forecast) ** 2)), 4) + 0.0 AS rmse, round(1 - sum((actual - forecast) ** 2) / sum((actual - base) ** 2), 4) + 0.0 AS r2_vs_base, round(avg(((actual - base >= 0) = (forecast - base >= 0))::INT), 4) + 0.0 AS direction_accuracy FROM ar WHERE forecast IS NOT NULL GROUP BY 1",
    "interval_widths": f"WITH {_AR}, e AS (SELECT period_end, abs(actual - forecast) AS e FROM ar WHERE forecast IS NOT NULL) SELECT a.period_end, round(coalesce(quantile_cont(b.e, 0.9), 3.0), 4) + 0.0 AS width FROM e a LEFT JOIN e b ON b.period_end < a.period_end GROUP BY 1",
    "ridge_gram": "WITH x AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT " + ", ".join(f"sum({'1.0::DOUBLE' if a == '1' else a} * {'1.0::DOUBLE' if b == '1' else b}) AS c{k}" for k, (a, b) in enumerate(_PAIRS)) + " FROM x) SELECT unnest([" + ", ".join(f"'{a}'" for a, _ in _PAIRS) + "]) AS i, unnest([" + ", ".join(f"'{b}'" for _, b in _PAIRS) + "]) AS j, round(unnest([" + ", ".join(f"c{k}" for k in range(len(_PAIRS))) + "]), 2) + 0.0 AS value FROM s",
    "seasonal_terms": f"WITH {TARGETS} SELECT period_end, round(sin(month(period_end) * pi() / 6), 6) + 0.0 AS season_sin, round(cos(month(period_end) * pi() / 6), 6) + 0.0 AS season_cos FROM targets",
}
