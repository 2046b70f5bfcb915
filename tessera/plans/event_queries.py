"""Queries over links, events, second annotations, learnable documents and route forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import period_end
from tessera.functions import text
from tessera.functions.numbers import rounded as r
from tessera.operators import annotation, corpus, events, factors, market, routes, rules, strategy
from tessera.plans import market_queries, rule_queries
from tessera.plans import views as v
from tessera.plans.text_queries import _NORMAL_URL, _long_features
from tessera.plans.views import DISCOVERY_END, FLAGGED, TARGETS, VALIDATION_END

KINDS = ("policy", "announcement", "ir_qa", "news")
#: Words for the given texts, in place of those of the lexicon.
SCHEMA = {"license_named": ("Apache License", "MIT License", "General Public License", "CC BY"), "authoritative_source": ("src1", "src2"), "quantitative_evidence": (), "shouting": ("!!", "###")}
TYPES = {"license_event": ("License", "CC BY"), "shouting": ("!!",), "listing": (" | ",)}
POLICY_WORDS, ATTENTION_WORDS = (" the ", " der ", " de "), (" la ", " le ")
POOL = [("E1", "Apache", "open", 5.0), ("E2", "Public", "open", 9.0), ("E3", "MIT", "open", 7.0), ("E4", "Creative", "shared", 3.0), ("E5", "Commons", "shared", 4.0)]
ALIASES = [("E1", "Apache License"), ("E2", "General Public License"), ("E3", "MIT License"), ("E4", "CC BY")]
SECTOR_WORDS = [("open", "%"), ("shared", "!!")]
THEMES = ((" der ", ("open", "shared"), "german"), (" the ", ("open",), "english"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 4).cast("int"))
    return v.dated(spark, sf_dir, "text", "source").select("doc_id", "publish_time", kind.alias("source_type"), F.col("source").alias("source_name"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"))


_ARTICLES = "articles AS (SELECT doc_id, CAST('1995-01-02' AS DATE) + CAST(doc_id % 2499 AS INTEGER) AS publish_time, ['policy', 'announcement', 'ir_qa', 'news'][doc_id % 4 + 1] AS source_type, source AS source_name, substring(text, 1, 60) AS title, text AS content FROM documents)"


def research_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.research_predicates(_articles(spark, sf_dir), SCHEMA)
    return out.select("doc_id", "name", "value", "evidence_text", r(F.col("confidence")).alias("confidence"))


def _pool(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(POOL, "entity string, name string, sector string, size double"), spark.createDataFrame(ALIASES, "entity string, alias string")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, aliases = _pool(spark)
    return events.link_cascade(_articles(spark, sf_dir), pool, aliases, SECTOR_WORDS, THEMES)


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("doc_id", "entity", "sector", r(F.col("confidence")).alias("confidence"), "evidence", F.col("link_pos").cast("long").alias("link_pos"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = events.event_type(F.col("source_type"), events.whole_text(), TYPES, POLICY_WORDS, ATTENTION_WORDS)
    out = events.build_events(_articles(spark, sf_dir), _links(spark, sf_dir), kind)
    return out.select("event_id", "doc_id", "entity", "event_type", "subject")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.flagged(spark, sf_dir).select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in v.FLAGS]))).alias("name"))


RULES = [("R1", ["has_digit", "long_text"]), ("R2", ["piped"]), ("R3", ["shouting", "has_percent", "has_digit"]), ("R4", ["many_lines", "many_lines"])]


def frozen_rules_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_id string, conditions array<string>")
    return annotation.matched_rules(_gated(spark, sf_dir), rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_id"))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second annotated document proposes the rules; those of good quality have an open gate."""
    labels = v.table(spark, sf_dir, "labels")
    rules = F.array(*[F.struct(F.lit(i).alias("position"), F.array(*[F.lit(c) for c in cs]).alias("conditions")) for i, (_, cs) in enumerate(RULES)])
    proposed = labels.select("doc_id", (0.2 + (F.col("doc_id") % 9) / 10).alias("confidence"), F.explode(rules).alias("c")).select("doc_id", "c.position", "c.conditions", "confidence")
    fused = v.flagged(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").cast("string").alias("fused")) for n in v.FLAGS])).alias("p")).select("doc_id", "p.*")
    return annotation.candidate_scores(proposed, fused, labels.filter("quality = 1")).select("doc_id", "position", "hits", "score")


def _signed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    flags = v.flagged(spark, sf_dir)
    row = lambda d, c: F.struct(F.lit("digits").alias("name"), (d != 0).alias("value"), d.cast("int").alias("direction"), F.when(d != 0, c).otherwise(0.0).alias("intensity"), c.alias("confidence"), F.lit(2).alias("lag"), F.when(d != 0, F.lit("0")).otherwise("").alias("evidence_text"))
    own = flags.select("doc_id", row(F.when(F.col("has_digit"), 1).otherwise(0), F.lit(0.6)).alias("p")).select("doc_id", "p.*")
    other = v.table(spark, sf_dir, "labels").select("doc_id", row((F.col("doc_id") % 3 - 1), (F.col("doc_id") % 10) / 10.0).alias("p")).select("doc_id", "p.*")
    return own, other


def signed_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = _signed(spark, sf_dir)
    return annotation.fuse_signed(own, other).select("doc_id", "value", "direction", r(F.col("intensity"), 4).alias("intensity"), r(F.col("confidence"), 4).alias("confidence"), "source")


def signed_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, other = _signed(spark, sf_dir)
    texts = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotation.signed_errors(other, texts, ["digits"]).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def learnable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents whose label was known at a day, those that may be annotated, and a relabelled year."""
    labels = v.table(spark, sf_dir, "labels")
    docs = v.dated(spark, sf_dir).withColumn("exit_trade_date", F.date_add("publish_time", (F.col("doc_id") % 9).cast("int")))
    reviewed = docs.withColumn("review_status", F.when(F.col("doc_id") % 5 == 0, "pending").otherwise("accepted"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(name).alias("set"), "n", "ids")
    stress = annotation.relabelled(docs.withColumn("split", F.lit("oos")), "1996-01-01", "1996-12-31", "stress", "publish_time").filter("split = 'stress'")
    return count(annotation.purged(docs.join(labels.select("doc_id"), "doc_id"), "1996-06-30"), "purged").unionByName(count(annotation.eligible(reviewed, labels, "1997-01-01"), "eligible")).unionByName(count(stress, "stress"))


def route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = routes.model_rows(v.targets(spark, sf_dir))
    return out.select("period_end", *[r(F.col(c), 5).alias(c) for c in ("target", "latest_released", "latest_change", "seasonal_value", "month_sin", "month_cos", "jan_feb")])


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("period_end")
    return routes.model_rows(v.targets(spark, sf_dir)).withColumn("split", F.when(year <= 1995, "train").when(year <= 1997, "validation").otherwise("oos"))


def route_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes without and with rule features, on the periods of orders and the predicates of documents."""
    base = _long_features(spark, sf_dir)
    ruled = base.filter("feature_name = 'piped_rate'").withColumn("feature_name", F.lit("rule.piped"))
    features = base.withColumn("route", F.lit("base")).unionByName(base.unionByName(ruled).withColumn("route", F.lit("rules")))
    out = routes.compare_routes(_splits(spark, sf_dir), features.select("route", "period_end", "feature_name", "feature_value"), ["base", "rules"], {"rules": ["rule."]})
    return out.select("route", "model", "alpha", "features", "available", "n", *[r(F.col(c), 5).alias(c) for c in ("mae", "rmse", "r2_vs_base", "direction_accuracy", "base_mae", "base_rmse", "base_direction_accuracy", "text_coverage", "coverage_90", "concentration", "oos_mae", "oos_rmse")], "qualified")


def simple_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = routes.baselines(_splits(spark, sf_dir), "validation")
    return out.select("model", "period_end", *[r(F.col(c), 4).alias(c) for c in ("actual", "base", "forecast")])


def selected_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.select_rules(rules.return_rules(rule_queries._events(spark, sf_dir)), 4, 0.3)
    return out.select("rule_id", F.array_join("conditions", " AND ").alias("conditions"), "status", "support_count", r(F.col("score"), 5).alias("score"))


def rule_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rule_queries._events(spark, sf_dir)
    every = rules.return_rules(ev).select(F.array_join("conditions", " AND ").alias("rule_id"), "conditions")
    out = rules.rule_diagnostics(every, ev, "1995-12-31", "1996-07-01")
    return out.select("rule_id", "discovery_documents", "discovery_dates", "discovery_entities", r(F.col("discovery_return")).alias("discovery_return"), "oos_documents", r(F.col("oos_return")).alias("oos_return"))


def quarterly_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strategy.quarterly_increments(market_queries._overlay_rows(spark, sf_dir, 0.25, 0.0), "baseline", "enhanced")
    return out.select("quarter", "observations", r(F.col("annualized_difference")).alias("annualized_difference"))


WEIGHTS = [0.5, 1.0, 2.0, 4.0]


def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, ret = market_queries._scores(spark, sf_dir)
    out = strategy.weight_grid(positions.select("day_idx", "trend_score"), positions.select("day_idx", "active_text_score"), ret, WEIGHTS, VALIDATION_END, DISCOVERY_END)
    return out.select("weight", "observations", r(F.col("sharpe"), 5).alias("sharpe"), r(F.col("annual_return"), 5).alias("annual_return"), "chosen")


def assembled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as two sources; every second page's link is unknown."""
    docs = _articles(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "source_type", "title", "content", "publish_time", "source_name", F.lit(None).cast("string").alias("url"))
    pages = v.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), F.lit("blog").alias("source_type"), F.lit("").alias("title"), F.col("html").alias("content"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("page_id") % 2499).cast("int")).alias("publish_time"), F.lit("web").alias("source_name"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("url"),
    )
    out = corpus.assemble([docs, pages], [" the ", " la "], "1995-01-02", "2001-12-31")
    return out.select("doc_id", "source_type", "publish_time", F.length("content").alias("n_chars"))


def fact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days' shipped quantities as a series."""
    from pyspark.sql import Window as W

    days = v.bars(spark, sf_dir).groupBy("trade_date").agg(F.sum("volume").alias("quantity"))
    series = days.select(F.col("trade_date").alias("day"), "quantity", (F.col("quantity") - F.lag("quantity").over(W.orderBy("trade_date"))).alias("change")).filter("change IS NOT NULL")
    return corpus.fact_documents(series, DISCOVERY_END, "shipped").select("doc_id", "title", "content", "publish_time")


def continuous_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.continuous_momentum(v.main(spark, sf_dir), [20]).select("day_idx", r(F.col("momentum_20d")).alias("momentum_20d"))


def dense_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' months with a large discount as factors, on all suppliers' bars."""
    bars = v.entity_bars(spark, sf_dir)
    known = bars.filter("factor >= 0.06").select("trade_date", "entity", F.col("factor").alias("factor_value"))
    out = factors.dense_panel(known, bars.select("trade_date", "entity", (F.col("close") / F.col("open") - 1).alias("excess")))
    return out.select("trade_date", "entity", r(F.col("factor_value")).alias("factor_value"), r(F.col("excess")).alias("excess"))


def cohort_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    return docs.select("doc_id", r(factors.cohort_rank("n_chars", ["lang", "source"])).alias("place"))


def dominant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent event type of each user."""
    events_ = v.table(spark, sf_dir, "events")
    return factors.dominant(events_.select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents").select("doc_id", text.first_snippets(F.col("text"), 3).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("snippets"))


QUERIES = {
    q.__name__: q
    for q in (continuous_momentum, dense_factors, cohort_ranks, dominant_types, snippets, selected_rules, rule_diagnostics, quarterly_increment, weight_grid, assembled_corpus, fact_documents, research_predicates, document_links, event_rows, frozen_rules_matched, candidate_scores, signed_fusion, signed_validation, learnable_documents, route_rows, route_comparison, simple_baselines)
}
DATES = {"route_rows": ["period_end"], "simple_baselines": ["period_end"], "assembled_corpus": ["publish_time"], "fact_documents": ["publish_time"], "dense_factors": ["trade_date"]}


def _first(text: str, words: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in words) + " END" if words else "NULL"


_TEXT = "title || chr(10) || content"
_PREDICATES = ", ".join(
    "{'name': '" + n + "', 'e': " + (f"nullif(regexp_extract({_TEXT}, '\\d+(?:\\.\\d+)?(?:%|万吨|吨|亿元|万辆|GWh|GW|套|家|个)', 0, 'i'), '')" if n == "quantitative_evidence" else _first(f"source_name || ' ' || {_TEXT}" if n == "authoritative_source" else _TEXT, w)) + "}"
    for n, w in SCHEMA.items()
)
_NAMES = [(e, n, s, n) for e, n, s, _ in POOL] + [(e, dict((x[0], x[1]) for x in POOL)[e], dict((x[0], x[2]) for x in POOL)[e], a) for e, a in ALIASES]
_LINKS = f"""{_ARTICLES}, names(entity, name, sector, alias) AS (VALUES {', '.join(map(repr, _NAMES))}), pool(entity, name, sector, size) AS (VALUES {', '.join(map(repr, POOL))}),
direct AS (SELECT doc_id, entity, any_value(name) AS name, any_value(sector) AS sector, arg_max(alias, {{'l': length(alias)}}) AS alias, any_value(title) AS title, any_value(content) AS content FROM articles JOIN names ON contains({_TEXT}, alias) GROUP BY 1, 2),
d AS (SELECT doc_id, entity, sector, CASE WHEN contains(title, name) THEN 0.98 WHEN contains(title, alias) THEN 0.95 WHEN contains(content, name) THEN 0.91 ELSE 0.84 END AS confidence, CASE WHEN contains(title, alias) THEN 'title: ' ELSE 'text: ' END || alias AS evidence, 0 AS step, -length(alias) AS place FROM direct),
open_docs AS (SELECT * FROM articles ANTI JOIN d USING (doc_id) WHERE source_type IN ('policy', 'news')),
words(sector, word, place) AS (VALUES {', '.join(repr((s, w, i)) for i, (s, w) in enumerate(SECTOR_WORDS))}),
fw AS (SELECT doc_id, any_value(source_type) AS source_type, sector, arg_min(word, place) AS word, min(place) AS place FROM open_docs JOIN words ON contains({_TEXT}, word) GROUP BY doc_id, sector),
s AS (SELECT doc_id, entity, fw.sector, CASE source_type WHEN 'policy' THEN 0.78 ELSE 0.70 END AS confidence, 'sector: ' || word AS evidence, 1 AS step, place FROM fw JOIN pool USING (sector)),
rest AS (SELECT *, CASE WHEN contains({_TEXT}, ' der ') THEN ' der ' WHEN contains({_TEXT}, ' the ') THEN ' the ' END AS word FROM open_docs ANTI JOIN fw USING (doc_id)),
themes(word, sector, k, theme) AS (VALUES {', '.join(repr((w, x, k, t)) for w, xs, t in THEMES for k, x in enumerate(xs))}),
best AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY size DESC, entity) AS rk FROM pool),
t AS (SELECT doc_id, entity, themes.sector, CASE source_type WHEN 'policy' THEN 0.64 ELSE 0.58 END AS confidence, 'theme: ' || rest.word || ', ' || theme AS evidence, 2 AS step, k * 1000 + rk AS place FROM rest JOIN themes USING (word) JOIN best ON best.sector = themes.sector AND rk <= 2),
links AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step, place, entity) AS link_pos FROM (FROM d UNION ALL FROM s UNION ALL FROM t))"""
_ANY = lambda words: "(" + " OR ".join(f"contains(title || ' ' || content, '{w}')" for w in words) + ")"
_GATED = FLAGGED + f", gated AS (SELECT doc_id, unnest(list_filter([{', '.join(f'CASE WHEN {n} THEN {n!r} END' for n in v.FLAGS)}], lambda x: x IS NOT NULL)) AS name FROM flagged)"
_HITS = [" + ".join(f"{c}::INT" for c in cs) for _, cs in RULES]
_SPLITS = TARGETS + """,
known AS (SELECT c.period_start, c.period_end, c.actual AS target, list(r.actual ORDER BY r.period_end DESC) AS y, list(r.actual ORDER BY r.period_end DESC) FILTER (month(r.period_end) = month(c.period_end)) AS same FROM targets c JOIN targets r ON r.release_date <= c.period_end GROUP BY 1, 2, 3),
model AS (SELECT period_end, target, y[1] AS latest_released, y[1] - coalesce(y[2], y[1]) AS latest_change, coalesce(same[1], y[1]) AS seasonal_value, sin(month(period_end) * pi() / 6) AS month_sin, cos(month(period_end) * pi() / 6) AS month_cos, (month(period_end) = 2)::INT::DOUBLE AS jan_feb FROM known)"""

_RULES = rule_queries.SQL["rule_score"]
_RULE_PARTS, _RULE_SCORE = _RULES.rsplit("SELECT conditions, support_count", 1)
_EVENT_SETS = """, sets AS (SELECT conditions, count(*) AS covered, sum(hash(event_id)::HUGEINT) AS cover, count(DISTINCT event_time) AS date_count FROM combos GROUP BY 1)"""
_COMBOS_WITH_ID = _RULE_PARTS.replace("combos AS (SELECT doc_id,", "combos AS (SELECT event_id, doc_id,").replace("UNION ALL SELECT x.doc_id, x.entity", "UNION ALL SELECT x.event_id, x.doc_id, x.entity").rstrip()
_NUM = lambda c: f"regexp_replace(printf('%.6f', ({c})::DOUBLE), '\\.?0+$', '')"
_MOVED = f"CASE WHEN change > 0 THEN 'rose by ' || {_NUM('change')} WHEN change < 0 THEN 'fell by ' || {_NUM('-change')} ELSE 'is unchanged' END"

SQL = {
    "continuous_momentum": f"WITH {v.MAIN} SELECT day_idx::INTEGER AS day_idx, round(close / lag(close, 20) OVER (ORDER BY trade_date) - 1, 6) + 0.0 AS momentum_20d FROM main",
    "dense_factors": f"WITH {v.ENTITY_BARS} SELECT trade_date, entity, round(CASE WHEN factor >= 0.06 THEN factor ELSE 0 END, 6) + 0.0 AS factor_value, round(close / open - 1, 6) + 0.0 AS excess FROM ebars WHERE trade_date IN (SELECT trade_date FROM ebars WHERE factor >= 0.06)",
    "cohort_ranks": "WITH x AS (SELECT doc_id, n_chars, min(n_chars) OVER w AS a, max(n_chars) OVER w AS b FROM documents WINDOW w AS (PARTITION BY lang, source)) SELECT doc_id, round(CASE WHEN b > a THEN (n_chars - a) / (b - a) ELSE 0.5 END, 6) + 0.0::DOUBLE AS place FROM x",
    "dominant_types": "SELECT user_id, arg_min(event_type, {'a': -n, 'b': first}) AS event_type, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1",
    "snippets": """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;])', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM documents),
d AS (SELECT doc_id, list_filter(s, lambda x, i: list_position(s, x) = i)[1:3] AS s FROM s) SELECT doc_id, len(s)::INTEGER AS n, array_to_string(s, '|') AS snippets FROM d""",
    "selected_rules": f"""{_COMBOS_WITH_ID}{_EVENT_SETS}, scored AS (SELECT x.*, s.covered, s.cover, (x.support_count >= 5 AND positive_count / x.support_count >= 0.5 AND x.avg_return >= 0 AND x.ev >= 0.3 AND entity_count >= 5 AND date_count >= 5)::INT AS q, f.score, string_split(x.conditions, ' AND ') AS names
  FROM x JOIN sets s USING (conditions) JOIN (SELECT conditions, score FROM (SELECT conditions, support_count{_RULE_SCORE})) f USING (conditions)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY covered, cover ORDER BY q DESC, score DESC, support_count DESC, terms, names) = 1 AS is_first, max(q) OVER () AS has_good FROM scored),
n AS (SELECT *, coalesce(sum(q) OVER (ORDER BY q DESC, score DESC, support_count DESC, terms, names ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (ORDER BY q DESC, score DESC, support_count DESC, terms, names) AS i FROM firsts WHERE is_first OR has_good = 0)
SELECT 'R' || lpad(i::VARCHAR, 3, '0') AS rule_id, conditions, CASE q WHEN 1 THEN 'qualified' ELSE 'candidate' END AS status, support_count, score FROM n WHERE CASE has_good WHEN 1 THEN b < 4 ELSE i <= 4 END""",
    "rule_diagnostics": f"""{_RULE_PARTS.rstrip()}, e AS (SELECT combos.* FROM combos SEMI JOIN x USING (conditions)),
d AS (SELECT conditions, doc_id, avg(excess) FILTER (event_time <= DATE '1995-12-31') AS a, avg(excess) FILTER (event_time >= DATE '1996-07-01') AS b FROM e GROUP BY 1, 2),
w AS (SELECT conditions, count(DISTINCT event_time) FILTER (event_time <= DATE '1995-12-31') AS dates, count(DISTINCT entity) FILTER (event_time <= DATE '1995-12-31') AS entities FROM e GROUP BY 1)
SELECT conditions AS rule_id, count(a) AS discovery_documents, any_value(dates) AS discovery_dates, any_value(entities) AS discovery_entities, round(coalesce(avg(a), 0), 6) + 0.0 AS discovery_return, count(b) AS oos_documents, round(coalesce(avg(b), 0), 6) + 0.0 AS oos_return FROM d JOIN w USING (conditions) GROUP BY conditions""",
    "quarterly_increment": f"WITH {market_queries._OVERLAY} SELECT year(trade_date) || 'Q' || quarter(trade_date) AS quarter, count(*) AS observations, round(avg(e.net_return - b.net_return) * 252, 6) + 0.0 AS annualized_difference FROM onet b JOIN onet e USING (trade_date) WHERE b.strategy = 'baseline' AND e.strategy = 'enhanced' GROUP BY 1",
    "weight_grid": f"""WITH {market_queries._TEXT}, p AS (SELECT day_idx, unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS weight, trend_score, active_text_score FROM trend JOIN text_scores USING (day_idx)),
q AS (SELECT trade_date, weight, greatest(-1, least(1, trend_score + weight * active_text_score)) AS position, market_open_return FROM p JOIN returns USING (day_idx) WHERE trade_date <= DATE '{VALIDATION_END}'),
t AS (SELECT *, position * market_open_return - abs(position - coalesce(lag(position) OVER (PARTITION BY weight ORDER BY trade_date), 0)) * 5 / 10000 AS net FROM q),
m AS (SELECT weight, count(*) AS observations, product(1 + net) ** (252 / count(*)) - 1 AS ar, stddev_pop(net) * sqrt(252) AS av FROM t WHERE trade_date > DATE '{DISCOVERY_END}' GROUP BY 1)
SELECT weight, observations, round(ar / av, 5) + 0.0 AS sharpe, round(ar, 5) + 0.0 AS annual_return, row_number() OVER (ORDER BY ar / av DESC, weight) = 1 AS chosen FROM m""",
    "assembled_corpus": f"""WITH {_ARTICLES}, whole AS (SELECT 'd' || doc_id AS doc_id, source_type, title, content, publish_time, '' AS u FROM articles
  UNION ALL SELECT 'p' || page_id, 'news', '', html, DATE '1995-01-02' + CAST(page_id % 2499 AS INTEGER), CASE WHEN page_id % 2 = 0 THEN regexp_replace(trim(coalesce(url, '')), '#.*$', '') ELSE '' END FROM pages),
good AS (SELECT *, {_NORMAL_URL} AS link FROM whole WHERE publish_time BETWEEN DATE '1995-01-02' AND DATE '2001-12-31' AND (contains({_TEXT}, ' the ') OR contains({_TEXT}, ' la ')) AND length(trim(content, ' ')) >= 40),
k AS (SELECT *, CASE WHEN link <> '' THEN 'u:' || link ELSE 't:' || substring(lower(regexp_replace(substring(content, 1, 12000), '[^0-9a-zA-Z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')), 1, 800) END AS key FROM good)
SELECT arg_min(doc_id, {{'a': publish_time, 'b': doc_id}}) AS doc_id, arg_min(source_type, {{'a': publish_time, 'b': doc_id}}) AS source_type, min(publish_time) AS publish_time, arg_min(least(length(content), 12000), {{'a': publish_time, 'b': doc_id}}) AS n_chars FROM k GROUP BY key""",
    "fact_documents": f"""WITH {v.BARS}, s AS (SELECT trade_date AS day, sum(volume) AS quantity FROM bars GROUP BY 1), c AS (SELECT *, quantity - lag(quantity) OVER (ORDER BY day) AS change FROM s),
l AS (SELECT quantile_disc(abs(change), 0.75) AS least FROM c WHERE change <> 0 AND day <= DATE '{DISCOVERY_END}')
SELECT 'FACT-' || strftime(day, '%Y%m%d') AS doc_id, 'shipped ' || {_MOVED} AS title, strftime(day, '%Y-%m-%d') || ': shipped is ' || {_NUM('quantity')} || ' and ' || {_MOVED} || '.' AS content, day AS publish_time FROM c, l WHERE abs(change) >= least""",
    "research_predicates": f"WITH {_ARTICLES}, p AS (SELECT doc_id, unnest([{_PREDICATES}]) AS p FROM articles) SELECT doc_id, p.name AS name, p.e IS NOT NULL AS value, coalesce(p.e, '') AS evidence_text, (CASE WHEN p.e IS NOT NULL THEN 0.70 ELSE 0.65 END)::DOUBLE AS confidence FROM p",
    "document_links": f"WITH {_LINKS} SELECT doc_id, entity, sector, confidence::DOUBLE AS confidence, evidence, link_pos FROM links",
    "event_rows": f"""WITH {_LINKS}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id, link_pos) AS number FROM links),
asked AS (SELECT doc_id, entity, publish_time AS day FROM links JOIN articles USING (doc_id) WHERE source_type = 'ir_qa'),
busy AS (SELECT a.entity, a.day, count(*) FILTER (b.day > a.day - 7) AS short, count(*) FILTER (b.day <= a.day - 7) AS base FROM (SELECT DISTINCT entity, day FROM asked) a JOIN asked b ON a.entity = b.entity AND b.day BETWEEN a.day - 36 AND a.day GROUP BY 1, 2),
pressed AS (SELECT DISTINCT doc_id, entity FROM asked JOIN busy USING (entity, day) WHERE short >= 3 AND short / 7 > greatest(base / 30, 0.05) * 2),
typed AS (SELECT *, CASE WHEN source_type = 'ir_qa' THEN NULL WHEN source_type = 'policy' THEN CASE WHEN {_ANY(POLICY_WORDS)} THEN 'policy_support' END
  {' '.join(f"WHEN {_ANY(w)} THEN '{n}'" for n, w in TYPES.items())} WHEN source_type = 'news' AND {_ANY(ATTENTION_WORDS)} THEN 'attention_spread' END AS kind FROM articles),
e AS (SELECT number, n.doc_id, n.entity, CASE WHEN p.doc_id IS NOT NULL THEN 'investor_question_pressure' ELSE kind END AS event_type, CASE source_type WHEN 'announcement' THEN title WHEN 'ir_qa' THEN '投资者与公司管理层' ELSE source_name END AS subject
  FROM n JOIN typed USING (doc_id) LEFT JOIN pressed p ON p.doc_id = n.doc_id AND p.entity = n.entity)
SELECT 'E' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END AS event_id, doc_id, entity, event_type, subject FROM e WHERE event_type IS NOT NULL""",
    "frozen_rules_matched": "WITH " + FLAGGED + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS rule_id, count(*) AS documents, min(doc_id) AS first_id FROM flagged WHERE {' AND '.join(cs)}" for i, cs in RULES) + ") WHERE documents > 0",
    "candidate_scores": f"WITH {FLAGGED}, x AS (SELECT doc_id, 0.2 + (doc_id % 9) / 10 AS confidence, unnest([{', '.join('{' + chr(39) + 'position' + chr(39) + f': {i}, ' + chr(39) + 'hits' + chr(39) + f': {h}, ' + chr(39) + 'size' + chr(39) + f': {len(RULES[i][1])}' + '}' for i, h in enumerate(_HITS[:3]))}]) AS c FROM labels JOIN flagged USING (doc_id) WHERE quality = 1) SELECT doc_id, c.position AS position, c.hits::BIGINT AS hits, round(0.8 * least(confidence, 1) * c.hits / c.size, 6) AS score FROM x",
    "signed_fusion": f"""WITH {FLAGGED}, x AS (SELECT f.doc_id, has_digit::INT AS d, CASE WHEN has_digit THEN 0.6 ELSE 0 END::DOUBLE AS i, l.doc_id IS NULL AS alone, f.doc_id % 3 - 1 AS od, CASE WHEN f.doc_id % 3 <> 1 THEN (f.doc_id % 10) / 10 ELSE 0 END AS oi, (f.doc_id % 10) / 10 AS oc FROM flagged f LEFT JOIN labels l USING (doc_id)),
y AS (SELECT *, d * i + (od * oi - d * i) * least(oc, 0.5) AS s FROM x)
SELECT doc_id, CASE WHEN alone THEN d <> 0 ELSE abs(s) > 1e-12 END AS value, (CASE WHEN alone THEN d ELSE sign(s) END)::INTEGER AS direction, round(CASE WHEN alone THEN i ELSE abs(s) END, 4) + 0.0 AS intensity, round(CASE WHEN alone THEN 0.6 ELSE greatest(0.6, oc) END, 4) + 0.0::DOUBLE AS confidence, CASE WHEN alone THEN 'deterministic' ELSE 'fused' END AS source FROM y""",
    "signed_validation": """SELECT error, count(*) AS n FROM (SELECT 'ungrounded' AS error FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 <> 1 AND NOT contains(text, '0') UNION ALL SELECT 'missing_predicate' FROM documents ANTI JOIN labels USING (doc_id)) GROUP BY 1""",
    "learnable_documents": """WITH d AS (SELECT doc_id, CAST('1995-01-02' AS DATE) + CAST(doc_id % 2499 AS INTEGER) AS day FROM documents)
SELECT 'purged' AS set, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM d SEMI JOIN labels USING (doc_id) WHERE day <= DATE '1996-06-30' AND day + (doc_id % 9)::INTEGER <= DATE '1996-06-30'
UNION ALL SELECT 'eligible', count(*), sum(doc_id)::BIGINT FROM d WHERE doc_id % 5 <> 0 AND (day >= DATE '1997-01-01' OR doc_id IN (SELECT doc_id FROM labels))
UNION ALL SELECT 'stress', count(*), sum(doc_id)::BIGINT FROM d WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""",
    "route_rows": f"WITH {_SPLITS} SELECT period_end, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("target", "latest_released", "latest_change", "seasonal_value", "month_sin", "month_cos", "jan_feb")) + " FROM model",
    "simple_baselines": f"""WITH {_SPLITS}, fit AS (SELECT covar_pop(target, latest_released) * count(*) / (var_pop(latest_released) * count(*) + 0.1) AS b, avg(target) AS my, avg(latest_released) AS mx FROM model WHERE year(period_end) <= 1995),
x AS (SELECT unnest([{{'m': 'persistence', 'f': latest_released}}, {{'m': 'seasonal', 'f': seasonal_value}}, {{'m': 'ar1', 'f': my + b * (latest_released - mx)}}]) AS f, period_end, target, latest_released FROM model, fit WHERE year(period_end) BETWEEN 1996 AND 1997)
SELECT f.m AS model, period_end, round(target, 4) + 0.0 AS actual, round(latest_released, 4) + 0.0 AS base, round(f.f, 4) + 0.0 AS forecast FROM x""",
}
