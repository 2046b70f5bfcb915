"""Queries over dated documents, links and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import html, text
from tessera.functions.dates import advance_period, half_year, period_end, period_start
from tessera.functions.numbers import rounded as r
from tessera.functions.scoring import fused_value
from tessera.operators import consensus, dedup, factors, features, ledger, quality, retrieval
from tessera.plans import views as v
from tessera.plans.views import DATED, FLAGGED


def predicate_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flag with its documents, and how many periods and sources these span."""
    flags = v.flagged(spark, sf_dir, "source")
    long = flags.select("doc_id", "publish_time", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in v.FLAGS])).alias("p")).filter("p.value")
    return long.groupBy("p.name").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"), F.count_distinct(period_end(F.col("publish_time"))).alias("periods"))


_PERIOD_END = "CASE WHEN month(publish_time) <= 2 THEN last_day(make_date(year(publish_time), 2, 1)) ELSE last_day(publish_time) END"


def _annotations(spark: SparkSession, sf_dir: str):
    """The texts' own flags as one annotator, labels as the other."""
    flags = v.flagged(spark, sf_dir)
    own = flags.select("doc_id", F.explode(F.array(F.struct(F.lit("clean").alias("name"), (~F.col("piped") & ~F.col("shouting") & ~F.col("has_percent")).cast("string").alias("value")), F.struct(F.lit("harmless").alias("name"), F.lit("true").alias("value")))).alias("p")).select("doc_id", "p.*")
    other = v.table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.struct(F.lit("clean").alias("name"), (F.col("quality") == 1).cast("string").alias("value")), F.struct(F.lit("harmless").alias("name"), (F.col("toxic") == 0).cast("string").alias("value")))).alias("p"), (0.1 + (F.col("doc_id") % 9) / 10).alias("confidence")).select("doc_id", "p.*", "confidence")
    return own, other


_BOTH = FLAGGED + """,
own AS (SELECT doc_id, unnest(['clean', 'harmless']) AS name, unnest([NOT piped AND NOT shouting AND NOT has_percent, true]) AS value FROM flagged),
other AS (SELECT doc_id, unnest(['clean', 'harmless']) AS name, unnest([quality = 1, toxic = 0]) AS other_value, 0.1 + (doc_id % 9) / 10 AS confidence FROM labels),
both_sides AS (SELECT own.*, other_value, confidence FROM own LEFT JOIN other USING (doc_id, name))"""


def predicate_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = _annotations(spark, sf_dir)
    return consensus.consensus(own, other).groupBy("name", "status").agg(F.count(F.lit(1)).alias("documents"), F.count_if("accepted").alias("accepted"))


def predicate_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = _annotations(spark, sf_dir)
    met = own.join(other.withColumnRenamed("value", "other_value"), ["doc_id", "name"], "left")
    return met.select("doc_id", "name", r(fused_value(F.col("value"), F.col("other_value"), F.col("confidence"))).alias("fused"))


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "pages").select("page_id", text.normal_url(F.col("url")).alias("normal_url"))


_NORMAL_URL = """regexp_replace(lower(regexp_extract(u, '^([^/?]*://[^/?]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(u, '^(?:[^/?]*://[^/?]*)?([^?]*)', 1), '/+', '/', 'g'), '/+$', '')
  || coalesce('?' || nullif(list_aggregate(list_transform(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|spm|from|source)')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), 'string_agg', '&'), ''), ''), '\\s$', '')"""
_URLS = f"urls AS (SELECT page_id, {_NORMAL_URL} AS normal_url FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))"


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = v.table(spark, sf_dir, "pages").select("page_id", text.normal_url(F.col("url")).alias("normal_url"))
    return dedup.keep_earliest(pages, ["normal_url"], ["page_id"])


def text_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.dated(spark, sf_dir, "text").select("doc_id", "publish_time", text.fingerprint(F.col("text")).alias("fingerprint"))
    return dedup.keep_earliest(docs, ["fingerprint"], ["publish_time", "doc_id"])


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by period; only their ids, periods and texts."""
    docs = v.dated(spark, sf_dir, "text")
    return docs.withColumns({"period_end": period_end(F.col("publish_time")), "seq": F.col("doc_id")})


def ngram_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_short(spark, sf_dir)).select("earlier", "later")


def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _short(spark, sf_dir).drop("seq").withColumn("fingerprint", text.fingerprint(F.col("text")))
    return dedup.ordered_dedup(docs, ["doc_id", "fingerprint"]).select("doc_id", "publish_time")


def near_dup_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as new documents against pages; every second one comes without its link."""
    pages = v.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))
    return retrieval.probe_duplicate(pages.withColumn("url", F.when(F.col("doc_id") % 2 == 0, F.col("url"))), pages).select("doc_id", "duplicate_of", "duplicate_by")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = v.table(spark, sf_dir, "embeddings")
    out = retrieval.top_similar(vecs.filter("vec_id % 100 = 0"), vecs, 3)
    return out.select("query_id", "rank", "vec_id", r(F.col("similarity")).alias("similarity"))


def label_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector of each label: contrasting examples."""
    vecs = v.table(spark, sf_dir, "embeddings")
    return retrieval.top_similar(vecs.filter("vec_id % 100 = 0"), vecs, 1, ["label"]).select("query_id", "label", "vec_id", r(F.col("similarity")).alias("similarity"))


_COSINE = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS z FROM e),
s AS (SELECT q.vec_id AS query_id, p.vec_id, p.label, sum(q.z * p.z) AS similarity FROM u q JOIN u p ON q.i = p.i AND q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL)"""


def sparse_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items whose id is divisible by 100 against all by their character grams."""
    items = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    grams = retrieval.gram_counts(items)
    out = retrieval.sparse_cosine(grams.filter("doc_id % 100 = 0"), grams)
    return out.select("left_id", "right_id", r(F.col("cosine")).alias("cosine"))


def text_lengths_of_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.dated(spark, sf_dir, "text", "lang").select("lang", F.size(text.sentences(F.col("text"))).alias("n"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("sentences"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = v.table(spark, sf_dir, "pages").select("page_id", html.visible_text("html").alias("visible"))
    return pages.select("page_id", F.length("visible").alias("characters"), F.sha2("visible", 256).alias("digest"))


def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = v.table(spark, sf_dir, "benchmark").select("item_id", html.text_vector("text").alias("vector"))
    shown = F.array_join(F.transform("vector", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    return items.select("item_id", F.size("vector").alias("dims"), F.size(F.filter("vector", lambda x: x != 0)).alias("used"), F.sha2(shown, 256).alias("digest"))


def burst_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("day"))
    out = factors.burst(events)
    return out.select("entity", F.col("day").cast("string").alias("day"), "n", "last_7", "before_30")


def monthly_features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.flagged(spark, sf_dir, "source", "n_chars")
    out = features.wide_features(docs, ["has_digit", "piped"], ["n_chars"], ["src0", "src1"])
    return out.select("period_end", "document_count", "source_count", *[r(F.col(c)).alias(c) for c in ("has_digit_share", "piped_share", "n_chars_mean", "n_chars_median", "n_chars_p90")], "source_src0_count", "source_src1_count")


def _long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = v.flagged(spark, sf_dir)
    rows = flags.select(period_end(F.col("publish_time")).alias("period_end"), "doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("active"), F.when(F.col(n), ((F.col("doc_id") % 7) - 3) / 4).otherwise(0.0).alias("signed")) for n in ("has_digit", "piped", "shouting")])).alias("p"))
    return features.predicate_features(rows.select("period_end", "doc_id", "p.*"))


def monthly_features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_features(spark, sf_dir).select("period_end", "feature_name", r(F.col("feature_value")).alias("feature_value"), "document_count")


def route_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.routes(_long_features(spark, sf_dir), _long_features(spark, sf_dir).filter("feature_name = 'piped_rate'").withColumn("feature_name", F.lit("rule_piped")))
    wide = features.feature_matrix(rows.filter("route = 'weighted_rules'"), ["has_digit_rate", "rule_piped"])
    return wide.select("period_end", *[r(F.col(c)).alias(c) for c in ("has_digit_rate", "rule_piped")])


_LONG = FLAGGED + f""",
rows AS (SELECT {_PERIOD_END} AS period_end, doc_id, unnest(['has_digit', 'piped', 'shouting']) AS name, unnest([has_digit, piped, shouting]) AS active FROM flagged),
scored AS (SELECT *, CASE WHEN active THEN ((doc_id % 7) - 3) / 4.0 ELSE 0 END AS signed FROM rows),
sums AS (SELECT period_end, name, count(*) AS document_count, avg(active::INT) AS rate, avg(signed) AS net, ln(1 + sum(active::INT)) AS log_count FROM scored GROUP BY 1, 2),
long_rows AS (SELECT period_end, name || '_' || unnest(['rate', 'net', 'log_count']) AS feature_name, unnest([rate, net, log_count]) AS feature_value, document_count FROM sums)"""


def quantile_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(*[r(F.percentile("n_chars", q)).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.75)])


def quantile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("q75"))


def period_jan_feb(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("publish_time")
    return v.dated(spark, sf_dir).groupBy(period_start(d).alias("period_start"), period_end(d).alias("period_end"), half_year(d).alias("half")).agg(F.count(F.lit(1)).alias("documents"))


def advanced_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.dated(spark, sf_dir).select("doc_id", period_end(F.col("publish_time")).alias("period_end"))
    return docs.withColumn("later_end", advance_period(F.col("period_end"), F.col("doc_id") % 30)).select("doc_id", "period_end", "later_end")


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by their (not unique) key."""
    lines = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount")
    rules = [quality.not_in("l_returnflag", ["A", "N"]), quality.Rule("large_discount", F.col("l_discount") > 0.09), quality.not_positive("l_quantity")]
    return quality.violations(lines, ["l_orderkey", "l_linenumber"], rules).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def provenance_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as audit rows of documents: documents without one, and one whose recorded length is shorter."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("url"))
    audit = v.table(spark, sf_dir, "labels").join(docs, "doc_id").select((F.col("doc_id") + F.when(F.col("doc_id") % 20 == 0, 10_000_000).otherwise(0)).alias("doc_id"), F.sha2("content", 256).alias("content_sha256"), (F.length("content") - F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("original_chars"), F.when(F.col("doc_id") % 11 != 0, F.col("url")).alias("url"))
    return quality.provenance(docs, audit).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def ledger_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger; a second delivery changes some prices and repeats some customers under new keys."""
    own = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"))
    held = own.filter("id % 3 <> 0")
    incoming = own.filter("id % 10 = 0").withColumn("price", F.when(F.col("id") % 20 == 0, F.col("price") + 1).otherwise(F.col("price")))
    bad = ledger.conflicts(held, incoming, "id", ["price"], "owner").groupBy("conflict").agg(F.count(F.lit(1)).alias("n"))
    new = ledger.append_new(held, incoming, "id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("appended").alias("conflict"), "n")
    return bad.unionByName(new)


def frozen_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders up to 1996 are frozen under three names; then one table grows behind the day, rows of another change, and a third loses some: what no longer agrees."""
    orders, until = v.table(spark, sf_dir, "orders"), "1996-12-31"
    frozen = F.col("o_orderdate").cast("date") <= F.lit(until).cast("date")
    later = orders.withColumns({"o_orderkey": F.col("o_orderkey") + 100_000_000, "o_orderdate": F.date_add(F.col("o_orderdate").cast("date"), 3000).cast(orders.schema["o_orderdate"].dataType)})
    now = {
        "grown": orders.unionByName(later.select(*orders.columns)).repartition(5),
        "edited": orders.withColumn("o_totalprice", F.when((F.col("o_orderkey") % 100 == 0) & frozen, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))),
        "cut": orders.filter("o_orderkey % 100 <> 1"),
    }
    manifest = ledger.freeze({name: (orders, "o_orderdate") for name in now}, until)
    return ledger.changed(manifest, ledger.freeze({name: (df, "o_orderdate") for name, df in now.items()}, until))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("segment"))
    incoming = own.filter("doc_id % 4 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 8 == 0, 10_000_000).otherwise(0)).alias("doc_id"), F.lit("NEW").alias("segment"))
    return ledger.upsert(own, incoming).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_id"))


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences as entities: by name, else by a word of their family."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    names = [("apache", "Apache License", False), ("apache", "Apache License, Version 2.0", True), ("gpl", "GNU General Public License", True), ("mit", "MIT License", True)]
    aliases = spark.createDataFrame(names, "entity string, alias string, exact boolean")
    sectors = spark.createDataFrame([("creative", "CC BY"), ("creative", "CC BY-NC")], "entity string, word string")
    return retrieval.link_entities(docs, aliases, sectors).groupBy("entity", "basis", "confidence").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    q.__name__: q
    for q in (
        predicate_grounding, predicate_consensus, predicate_fusion, url_normalize, url_dedup, text_fingerprint_dedup, ngram_near_dup, greedy_dedup, near_dup_probe, cosine_topk, label_contexts, sparse_cosine,
        text_lengths_of_sentences, html_text, hashed_embedding, burst_window, monthly_features_wide, monthly_features_long, route_matrix, quantile_interpolated, quantile_nearest_rank, period_jan_feb, advanced_period,
        constraint_violations, provenance_anti_join, ledger_conflicts, frozen_prefix, upserted, entity_links,
    )
}

DATES = {
    "text_fingerprint_dedup": ["publish_time"], "greedy_dedup": ["publish_time"], "monthly_features_wide": ["period_end"], "monthly_features_long": ["period_end"], "route_matrix": ["period_end"],
    "period_jan_feb": ["period_start", "period_end"], "advanced_period": ["period_end", "later_end"],
}

_NORMAL = "lower(regexp_replace(text, '[^0-9a-zA-Z\\x{4e00}-\\x{9fff}]+', '', 'g'))"

SQL = {
    "predicate_grounding": f"WITH {FLAGGED}, x AS (SELECT unnest([{', '.join(repr(n) for n in v.FLAGS)}]) AS name, unnest([{', '.join(v.FLAGS)}]) AS value, source, {_PERIOD_END} AS p FROM flagged) SELECT name, count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT p) AS periods FROM x WHERE value GROUP BY name",
    "predicate_consensus": f"WITH {_BOTH}, x AS (SELECT name, value, CASE WHEN other_value IS NULL THEN 'invalid' WHEN value <> other_value THEN 'disputed' WHEN value THEN 'agreed_true' ELSE 'agreed_false' END AS status FROM both_sides) SELECT name, status, count(*) AS documents, count(*) FILTER (status = 'agreed_true' AND value) AS accepted FROM x GROUP BY 1, 2",
    "predicate_fusion": f"WITH {_BOTH} SELECT doc_id, name, round(value::INT + CASE WHEN other_value IS NULL THEN 0 ELSE (other_value::INT - value::INT) * least(confidence, 0.5) END, 6) + 0.0 AS fused FROM both_sides",
    "url_normalize": f"WITH {_URLS} SELECT * FROM urls",
    "url_dedup": f"WITH {_URLS} SELECT min(page_id) AS page_id, normal_url FROM urls GROUP BY normal_url",
    "text_fingerprint_dedup": f"WITH {DATED}, x AS (SELECT doc_id, publish_time, sha256({_NORMAL}) AS fingerprint FROM dated) SELECT arg_min(doc_id, {{'a': publish_time, 'b': doc_id}}) AS doc_id, min(publish_time) AS publish_time, fingerprint FROM x GROUP BY fingerprint",
    "near_dup_probe": f"""WITH {_URLS}, p AS (SELECT page_id AS doc_id, normal_url, lower(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '[^0-9a-zA-Z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')) AS t FROM pages JOIN urls USING (page_id)),
a AS (SELECT normal_url, min(doc_id) AS by_url FROM p WHERE normal_url <> '' GROUP BY 1), b AS (SELECT t, min(doc_id) AS by_title FROM p WHERE length(t) >= 12 GROUP BY 1)
SELECT doc_id, coalesce(by_url, by_title) AS duplicate_of, CASE WHEN by_url IS NOT NULL THEN 'url' WHEN by_title IS NOT NULL THEN 'title' ELSE 'new' END AS duplicate_by FROM p LEFT JOIN a ON p.normal_url = a.normal_url AND doc_id % 2 = 0 LEFT JOIN b USING (t)""",
    "cosine_topk": f"WITH {_COSINE} SELECT query_id, rank::INTEGER AS rank, vec_id, round(similarity, 6) + 0.0 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 3",
    "label_contexts": f"WITH {_COSINE} SELECT query_id, label, vec_id, round(similarity, 6) + 0.0 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 1",
    "sparse_cosine": f"""WITH t AS (SELECT item_id, {_NORMAL} AS t FROM benchmark),
g AS (SELECT item_id, unnest(list_concat(list_transform(range(1, length(t)), lambda i: t[i:i + 1]), list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2]))) AS gram FROM t),
c AS (SELECT item_id, gram, count(*) AS n FROM g GROUP BY 1, 2), w AS (SELECT item_id, gram, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS w FROM c)
SELECT a.item_id AS left_id, b.item_id AS right_id, round(sum(a.w * b.w), 6) + 0.0 AS cosine FROM w a JOIN w b ON a.gram = b.gram AND a.item_id <> b.item_id WHERE a.item_id % 100 = 0 GROUP BY 1, 2""",
    "text_lengths_of_sentences": "SELECT lang, count(*) AS documents, sum(len(list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;])', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')))::BIGINT AS sentences FROM documents GROUP BY lang",
    "burst_window": """WITH c AS (SELECT user_id AS entity, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT entity, day::VARCHAR AS day, n, (sum(n) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))::BIGINT AS last_7, coalesce(sum(n) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 36 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING), 0)::BIGINT AS before_30 FROM c""",
    "monthly_features_wide": f"WITH {FLAGGED} SELECT {_PERIOD_END} AS period_end, count(*) AS document_count, count(DISTINCT source) AS source_count, round(avg(has_digit::INT), 6) + 0.0 AS has_digit_share, round(avg(piped::INT), 6) + 0.0 AS piped_share, round(avg(n_chars), 6) + 0.0 AS n_chars_mean, round(quantile_cont(n_chars, 0.5), 6) + 0.0 AS n_chars_median, round(quantile_cont(n_chars, 0.9), 6) + 0.0 AS n_chars_p90, count(*) FILTER (source = 'src0') AS source_src0_count, count(*) FILTER (source = 'src1') AS source_src1_count FROM flagged GROUP BY 1",
    "monthly_features_long": f"WITH {_LONG} SELECT period_end, feature_name, round(feature_value, 6) + 0.0 AS feature_value, document_count FROM long_rows",
    "route_matrix": f"WITH {_LONG} SELECT period_end, round(max(feature_value) FILTER (feature_name = 'has_digit_rate'), 6) + 0.0 AS has_digit_rate, round(max(feature_value) FILTER (feature_name = 'piped_rate') * 0.25, 6) + 0.0 AS rule_piped FROM long_rows GROUP BY 1",
    "quantile_interpolated": "SELECT lang, round(quantile_cont(n_chars, 0.1), 6) + 0.0 AS q10, round(quantile_cont(n_chars, 0.5), 6) + 0.0 AS q50, round(quantile_cont(n_chars, 0.75), 6) + 0.0 AS q75 FROM documents GROUP BY lang",
    "quantile_nearest_rank": "SELECT lang, quantile_disc(n_chars, 0.75)::BIGINT AS q75 FROM documents GROUP BY lang",
    "period_jan_feb": f"WITH {DATED} SELECT CASE WHEN month(publish_time) <= 2 THEN make_date(year(publish_time), 1, 1) ELSE date_trunc('month', publish_time)::DATE END AS period_start, {_PERIOD_END} AS period_end, year(publish_time) || CASE WHEN month(publish_time) <= 6 THEN 'H1' ELSE 'H2' END AS half, count(*) AS documents FROM dated GROUP BY 1, 2, 3",
    "advanced_period": f"""WITH {DATED}, x AS (SELECT doc_id, {_PERIOD_END} AS period_end FROM dated), o AS (SELECT *, year(period_end) * 11 + greatest(month(period_end) - 2, 0) + doc_id % 30 AS o FROM x)
SELECT doc_id, period_end, last_day(make_date((o // 11)::BIGINT, (CASE WHEN o % 11 = 0 THEN 2 ELSE o % 11 + 2 END)::BIGINT, 1)) AS later_end FROM o""",
    "constraint_violations": """WITH x AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT violation, count(*) AS n FROM (SELECT 'invalid_l_returnflag' AS violation FROM x WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'large_discount' FROM x WHERE l_discount > 0.09
  UNION ALL SELECT 'nonpositive_l_quantity' FROM x WHERE l_quantity <= 0 UNION ALL SELECT 'duplicate_key' FROM x WHERE n > 1) GROUP BY 1""",
    "provenance_anti_join": """WITH a AS (SELECT CASE WHEN doc_id % 20 = 0 THEN doc_id + 10000000 ELSE doc_id END AS doc_id, doc_id % 7 = 0 AND doc_id % 20 <> 0 AS short, doc_id % 11 = 0 AND doc_id % 20 <> 0 AS nourl FROM labels JOIN documents USING (doc_id)),
x AS (SELECT d.doc_id, a.doc_id IS NULL AS absent, coalesce(a.short, false) AS short, coalesce(a.nourl, false) AS nourl FROM documents d LEFT JOIN a USING (doc_id))
SELECT problem, count(*) AS n FROM (SELECT 'no_audit_row' AS problem FROM x WHERE absent UNION ALL SELECT 'longer_than_original' FROM x WHERE short UNION ALL SELECT 'url_differs' FROM x WHERE nourl
  UNION ALL SELECT 'orphan_audit_row' FROM a ANTI JOIN documents USING (doc_id)) GROUP BY 1""",
    "ledger_conflicts": """WITH held AS (SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderkey % 3 <> 0), inc AS (SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderkey % 10 = 0)
SELECT 'immutable_field_changed' AS conflict, count(*) AS n FROM inc SEMI JOIN held USING (id) WHERE id % 20 = 0
UNION ALL SELECT 'second_id_for_owner', count(DISTINCT i.id) FROM inc i JOIN held h ON h.owner = i.owner AND h.id <> i.id
UNION ALL SELECT 'appended', count(*) FROM inc ANTI JOIN held USING (id)""",
    "frozen_prefix": """WITH f AS (SELECT count(*) AS frozen_rows, count(*) FILTER (o_orderkey % 100 = 0) AS edits, count(*) FILTER (o_orderkey % 100 = 1) AS cuts FROM orders WHERE o_orderdate::DATE <= DATE '1996-12-31')
SELECT 'edited' AS name, frozen_rows, frozen_rows AS rows_now FROM f WHERE edits > 0 UNION ALL SELECT 'cut', frozen_rows, frozen_rows - cuts FROM f WHERE cuts > 0""",
    "upserted": """WITH inc AS (SELECT CASE WHEN c_custkey % 8 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS doc_id, 'NEW' AS segment FROM customer WHERE c_custkey % 4 = 0),
u AS (SELECT c_custkey AS doc_id, c_mktsegment AS segment FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM inc) UNION ALL SELECT * FROM inc)
SELECT segment, count(*) AS n, max(doc_id) AS last_id FROM u GROUP BY 1""",
    "entity_links": """WITH a(entity, alias, exact) AS (VALUES ('apache', 'Apache License', false), ('apache', 'Apache License, Version 2.0', true), ('gpl', 'GNU General Public License', true), ('mit', 'MIT License', true)),
d AS (SELECT doc_id, entity, arg_max(alias, length(alias)) AS basis, arg_max(exact, length(alias)) AS exact FROM documents JOIN a ON contains(text, alias) GROUP BY 1, 2),
t AS (SELECT doc_id, 'creative' AS entity, 'CC BY' AS basis FROM documents ANTI JOIN d USING (doc_id) WHERE contains(text, 'CC BY'))
SELECT entity, basis, confidence, count(*) AS documents FROM (SELECT entity, basis, CASE WHEN exact THEN 0.98 ELSE 0.95 END::DOUBLE AS confidence FROM d UNION ALL SELECT entity, basis, 0.91::DOUBLE FROM t) GROUP BY ALL""",
}
