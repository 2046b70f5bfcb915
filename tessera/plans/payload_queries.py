"""Queries over annotation payloads that are built from labels and documents, with every kind of error at known places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import payloads
from tessera.plans import views as v

#: The flags of a text are the true-or-false predicates; two are scores.
SCHEMA = payloads.Schema(tuple(v.FLAGS), ("strength", "impact"), ("evidence", "novelty", "risk"), {"src0": ("praise", "notice"), "src1": ("notice", "complaint"), "src2": ("complaint",)})
_TYPES = ("praise", "notice", "complaint")


def _sql_payload() -> str:
    """The payload of a labelled document, by doc_id % 20: what is broken in it."""
    kind = "doc_id % 20"
    predicate = lambda name, value: f"concat('{{\"name\":\"{name}\",\"value\":', {value}, ',\"confidence\":0.5}}')"
    flags = [predicate(n, f"CASE WHEN {n} THEN 'true' ELSE 'false' END") for n in v.FLAGS if n not in ("piped", "shouting")]
    last = f"CASE WHEN {kind} = 1 THEN '\"maybe\"' WHEN piped THEN 'true' ELSE 'false' END"
    items = [*flags, predicate("piped", last), f"CASE WHEN {kind} = 2 THEN '{{\"name\":\"guess\",\"value\":true}}' ELSE {predicate('shouting', chr(39) + 'true' + chr(39))} END"]
    items += [predicate("strength", f"CASE WHEN {kind} = 3 THEN '1.5' WHEN {kind} = 4 THEN '\"high\"' ELSE '0.25' END"), predicate("impact", "'1'")]
    items += [f"CASE WHEN {kind} = 5 THEN {predicate('impact', chr(39) + '0' + chr(39))} ELSE '7' END"]
    entity = lambda code, parts: f"concat('{{\"code\":\"', {code}, '\",\"relationship_evidence\":\"', CASE WHEN {kind} = 6 THEN 'never said so' ELSE word END, '\",\"score_components\":{{', {parts}, '}},\"predicates\":[', concat_ws(',', {', '.join(items)}), ']}}')"
    whole, part = "'\"evidence\":1,\"novelty\":0,\"risk\":0.5'", "'\"evidence\":1,\"risk\":0.5'"
    codes = f"CASE WHEN {kind} = 7 THEN 'nobody' ELSE concat('E', CAST(doc_id % 5 AS STRING)) END"
    one = entity(codes, f"CASE WHEN {kind} = 8 THEN {part} ELSE {whole} END")
    two = f"CASE WHEN {kind} = 9 THEN concat(',', {entity(codes, whole)}) ELSE '' END"
    list_ = f"CASE WHEN {kind} = 10 THEN '\"none\"' WHEN {kind} = 11 THEN '[]' ELSE concat('[', {one}, {two}, ',3]') END"
    type_ = f"CASE WHEN {kind} = 12 THEN 'rumour' WHEN {kind} = 13 THEN CASE WHEN source = 'src0' THEN 'complaint' ELSE 'praise' END ELSE CASE WHEN source = 'src2' THEN 'complaint' ELSE 'notice' END END"
    object_ = f"CASE WHEN {kind} = 14 THEN ' ' ELSE 'thing' END"
    evidence = f"CASE WHEN {kind} = 15 THEN 'never said so' ELSE word END"
    event = f"concat('{{\"event_type\":\"', {type_}, '\",\"subject\":\"who }} \\\\\"x\\\\\"\",\"object\":\"', {object_}, '\",\"impact_path\":\"a to b\",\"evidence_text\":\"', {evidence}, '\"}}')"
    body = f"concat('{{\"event\":', {event}, ',\"analyses\":', {list_}, '}}')"
    return f"CASE WHEN {kind} = 16 THEN 'sorry, nothing' WHEN {kind} = 17 THEN substring({body}, 1, 60) WHEN {kind} = 18 THEN concat('Here it is:\n```json\n', {body}, '\n```\nand {{more}}') ELSE {body} END"


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind of source, text and payload of every labelled document."""
    docs = v.flagged(spark, sf_dir, "source", "text").join(v.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    word = F.coalesce(F.regexp_extract(F.col("text"), "[A-Za-z]+", 0), F.lit(""))
    docs = docs.withColumn("word", word).filter("word <> ''")
    return docs.select("doc_id", F.col("source").alias("kind"), "text", F.expr(_sql_payload()).alias("payload"))


def _entities(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("entity"))


def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.violations(built(spark, sf_dir), _entities(spark), SCHEMA)
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc_id"))


def accepted_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.accepted_predicates(built(spark, sf_dir), _entities(spark), SCHEMA)
    return rows.groupBy("entity", "name", "value").agg(F.count_distinct("doc_id").alias("documents"))


QUERIES = {"payload_errors": payload_errors, "accepted_predicates": accepted_predicates}
DATES: dict[str, list[str]] = {}
_BUILT = f"""{v.FLAGGED}, b AS (SELECT f.doc_id, f.doc_id % 20 AS k, f.source, {', '.join('f.' + n for n in v.FLAGS)} FROM flagged f JOIN labels USING (doc_id) JOIN documents d ON d.doc_id = f.doc_id WHERE regexp_extract(d.text, '[A-Za-z]+') <> '')"""
#: What each kind of payload must be told: by how it was built, not by reading it.
_KINDS = {
    1: ("not_boolean", "missing_predicates"), 2: ("unknown_predicate", "missing_predicates"), 3: ("score_out_of_range", "missing_predicates"), 4: ("not_a_score", "missing_predicates"),
    5: ("repeated_predicate",), 6: ("relationship_not_in_text",), 7: ("unknown_entity",), 8: ("incomplete_components",), 9: ("repeated_entity",), 10: ("analyses_no_array",),
    11: ("no_analyses",), 12: ("unknown_event_type",), 13: ("event_type_of_other_source",), 14: ("missing_object",), 15: ("evidence_not_in_text",), 16: ("unreadable",), 17: ("unreadable",),
}
_TOLD = ", ".join(f"({k}, '{e}')" for k, errors in _KINDS.items() for e in errors)
SQL = {
    "payload_errors": f"WITH {_BUILT} SELECT e.error, count(*) AS n, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc_id FROM b JOIN (VALUES {_TOLD}) e(k, error) ON e.k = b.k AND NOT (e.k = 13 AND source NOT IN ('src0', 'src1', 'src2')) GROUP BY 1",
    "accepted_predicates": f"""WITH {_BUILT}, good AS (SELECT * FROM b WHERE k IN (0, 5, 6, 9, 18, 19) OR (k = 13 AND source NOT IN ('src0', 'src1', 'src2'))),
p AS (SELECT doc_id, 'E' || (doc_id % 5) AS entity, unnest([{', '.join(f"{{'name': '{n}', 'value': CASE WHEN {'true' if n == 'shouting' else n} THEN 'true' ELSE 'false' END}}" for n in v.FLAGS)}, {{'name': 'strength', 'value': '0.25'}}, {{'name': 'impact', 'value': '1.00'}}]) AS x FROM good)
SELECT entity, x.name AS name, x.value AS value, count(DISTINCT doc_id) AS documents FROM p GROUP BY 1, 2, 3""",
}
