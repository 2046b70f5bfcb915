"""Queries over period features of documents with events, predicates, links, factors, rule hits and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import period_end
from tessera.functions.numbers import rounded as r
from tessera.operators import period_facts
from tessera.plans import views as v

TOPICS = ["has_license", "many_lines"]
SOURCES = ["src0", "src1", "src2", "src3"]
NAMES = list(v.FLAGS)


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Canonical documents (one of each text), and facts about all documents, by their number and flags."""
    docs = v.flagged(spark, sf_dir, "source", "lang", "n_chars")
    text = v.table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text", F.length("text")).alias("print"))
    plain = docs.join(text, "doc_id").withColumns({"period_end": period_end(F.col("publish_time")), "source_name": F.concat_ws("/", "source", "lang"), "source_type": F.col("source")})
    own = period_facts.canonical(plain, F.col("print"))
    ids = docs.select("doc_id", "n_chars", *NAMES)
    events = ids.select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("j"), *NAMES)
    event = events.select("doc_id", (F.col("doc_id") * 10 + F.col("j")).alias("event_id"), ((F.col("doc_id") * 7 + F.col("j")) % 13).alias("stock"), ((F.col("doc_id") + F.col("j")) % 10 / 10).alias("strength"))
    value = lambda n: F.when((F.col("doc_id") % 17 == 4) & (n == NAMES[0]), "unknown").otherwise(F.col(n).cast("string"))
    predicate = events.select("doc_id", "j", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), value(n).alias("value")) for n in NAMES])).alias("p")).select("doc_id", "p.name", "p.value", (F.col("j") / 4).alias("confidence"))
    link = ids.filter("doc_id % 4 > 0").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int"))).alias("k")).select("doc_id", (F.col("k") / 5).alias("confidence"))
    factor = ids.filter("doc_id % 5 < 3").select("doc_id", ((F.col("n_chars") % 21 - 8) / 4).alias("value"))
    rule = ids.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("has_digit") & F.col("piped"), "R1"), F.when(F.col("long_text"), "R2"), F.when(F.col("long_text"), "R2")))).alias("rule_id"))
    annotation = v.table(spark, sf_dir, "labels").select("doc_id")
    return own, {"event": event, "predicate": predicate, "link": link, "factor": factor, "rule": rule, "annotation": annotation}


def period_fact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = facts(spark, sf_dir)
    out = period_facts.period_features(own, found, NAMES, TOPICS, SOURCES)
    kinds = dict(out.dtypes)
    return out.select(*[r(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in out.columns])


QUERIES = {"period_fact_features": period_fact_features}
DATES = {"period_fact_features": ["period_end"]}
_END = "CASE WHEN month(publish_time) <= 2 THEN last_day(make_date(year(publish_time), 2, 1)) ELSE last_day(publish_time) END"
_Z = lambda e, name: f"round(coalesce({e}, 0), 6) + 0.0::DOUBLE AS {name}"
_MEANS = ", ".join(_Z(f"p.{n}", f"predicate_{n}") for n in NAMES)
SQL = {
    "period_fact_features": f"""WITH {v.FLAGGED},
c AS (SELECT arg_min(doc_id, (publish_time, doc_id)) AS doc_id FROM flagged JOIN (SELECT doc_id, text FROM documents) t USING (doc_id) GROUP BY text),
d AS (SELECT f.*, {_END} AS e FROM flagged f JOIN c USING (doc_id)),
ev AS (SELECT e, d.*, unnest(range(1, d.doc_id % 3 + 2)) AS j FROM d),
events AS (SELECT e, count(*) AS event_count, count(DISTINCT (doc_id * 7 + j) % 13) AS stock_count, avg((doc_id + j) % 10 / 10) AS strength FROM ev GROUP BY 1),
pr AS (SELECT e, doc_id, j, unnest([{', '.join(f"{{'name': '{n}', 'value': " + (f"CASE WHEN doc_id % 17 = 4 THEN NULL ELSE {n} END" if i == 0 else n) + "}" for i, n in enumerate(NAMES))}]) AS x FROM ev),
p AS (SELECT e, count(*) AS predicate_count, count(*) FILTER (x.value) AS true_predicate_count, avg(x.value::INT) AS rate, avg(j / 4) AS confidence, {', '.join(f"avg(x.value::INT) FILTER (x.name = '{n}') AS {n}" for n in NAMES)} FROM pr GROUP BY 1),
l AS (SELECT e, avg(k / 5) AS confidence FROM (SELECT e, unnest(range(1, doc_id % 4 + 1)) AS k FROM d) GROUP BY 1),
f AS (SELECT e, avg(y) AS m, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c, CASE WHEN count(*) > 1 THEN stddev_pop(y) ELSE 0 END AS s, avg((y > 0)::INT) AS pos FROM (SELECT e, (n_chars % 21 - 8) / 4 AS y FROM d WHERE doc_id % 5 < 3) GROUP BY 1),
ds AS (SELECT e, count(*) AS document_count, count(DISTINCT source || '/' || lang) AS unique_source_count, sum((has_digit AND piped)::INT + long_text::INT)::BIGINT AS hits, count(*) FILTER ((has_digit AND piped) OR long_text) AS supporting,
  avg((doc_id IN (SELECT doc_id FROM labels))::INT) AS coverage, {', '.join(f"count(*) FILTER (source = '{s}') AS {s}_count" for s in SOURCES)}, {', '.join(f"count(*) FILTER ({t}) AS {t}" for t in TOPICS)} FROM d GROUP BY 1)
SELECT ds.e AS period_end, document_count, event_count, predicate_count, true_predicate_count, {_Z('p.rate', 'positive_predicate_rate')}, {_Z('p.confidence', 'avg_predicate_confidence')}, {_Z('strength', 'avg_event_evidence')}, {_Z('l.confidence', 'avg_entity_confidence')},
  hits AS qualified_rule_hits, supporting AS rule_supporting_document_count, {_Z('coverage', 'annotation_coverage')}, CASE WHEN document_count >= 5 THEN 'sufficient' ELSE 'insufficient' END AS coverage_status,
  {', '.join(f'{s}_count' for s in SOURCES)}, {', '.join('ds.' + t for t in TOPICS)}, {_MEANS}, unique_source_count, stock_count, {_Z('f.m', 'factor_mean')}, {_Z('f.a', 'factor_p25')}, {_Z('f.b', 'factor_median')}, {_Z('f.c', 'factor_p75')}, {_Z('f.s', 'factor_std')}, {_Z('f.pos', 'factor_positive_rate')}
FROM ds JOIN events USING (e) JOIN p USING (e) LEFT JOIN l USING (e) LEFT JOIN f USING (e)""",
}
