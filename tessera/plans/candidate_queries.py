"""Queries over listings whose rows are made from the given pages, with every reason for a rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import candidates
from tessera.plans import views as v

START, END = "2024-01-01", "2025-12-31"
_ROWS = {
    "stock_code": "concat('S', page_id % 7)", "page": "CAST(floor(page_id / 70) AS INT)", "place": "CAST(floor(page_id / 7) % 10 AS INT)",
    "found_code": "CASE WHEN page_id % 13 = 5 THEN 'S9' ELSE concat('S', page_id % 7) END",
    "question_id": "CASE WHEN page_id % 19 = 2 THEN '' WHEN page_id % 9 = 4 THEN concat('Q', page_id - 7) ELSE concat('Q', page_id) END",
    "published": "CASE WHEN page_id % 23 = 3 THEN 'soon' WHEN page_id % 10 = 6 THEN '1600000000' WHEN page_id % 2 = 0 THEN concat(CAST(1704038400 + page_id * 60 AS BIGINT), '000') ELSE CAST(CAST(1704038400 + page_id * 60 AS BIGINT) AS {text}) END",
    "detail_code": "CASE WHEN page_id % 17 = 8 THEN 'S9' ELSE concat('S', page_id % 7) END",
    "detail_date": "CAST(CAST(1704038400 + page_id * 3600 AS BIGINT) AS {text})", "question": "concat('<b>Question</b> &amp; ', page_id % 101)", "reply": "CASE WHEN page_id % 12 = 7 THEN ' <br> ' ELSE concat('Answer ', page_id % 3) END",
}


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "pages").select("page_id", *[F.expr(e.format(text="STRING")).alias(c) for c, e in _ROWS.items()])


def candidate_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.rejections(candidates.judged(_listing(spark, sf_dir), START, END))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates.judged(_listing(spark, sf_dir), START, END).filter("reason IS NULL")
    return rows.select("page_id", "stock_code", "question_id", "question", "reply", "day", "content_sha256")


QUERIES = {"candidate_rejections": candidate_rejections, "candidate_rows": candidate_rows}
DATES = {"candidate_rows": ["day"]}
_JUDGED = f"""r AS (SELECT page_id, {', '.join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in _ROWS.items())} FROM pages),
n AS (SELECT *, TRY_CAST(published AS BIGINT) AS p, TRY_CAST(detail_date AS BIGINT) AS q FROM r),
d AS (SELECT * EXCLUDE (question, reply), 'Question & ' || (page_id % 101) AS question, CASE WHEN page_id % 12 = 7 THEN '' ELSE reply END AS reply,
  coalesce((DATE '1970-01-01' + (((CASE WHEN p > 10000000000 THEN p // 1000 ELSE p END) + 28800) // 86400)::INT) BETWEEN DATE '{START}' AND DATE '{END}', false) AS listed, (DATE '1970-01-01' + ((q + 28800) // 86400)::INT)::DATE AS day FROM n),
f AS (SELECT *, min(CASE WHEN found_code = stock_code AND listed THEN (stock_code, page, place) END) OVER (PARTITION BY question_id) AS first FROM d),
j AS (SELECT *, CASE WHEN found_code <> stock_code THEN 'other_stock' WHEN question_id = '' OR (stock_code, page, place) > first THEN 'duplicate_question' WHEN NOT listed THEN 'out_of_window'
  WHEN detail_code <> stock_code OR day NOT BETWEEN DATE '{START}' AND DATE '{END}' OR reply = '' THEN 'detail_rejected' END AS reason0, sha256(question || chr(10) || reply) AS content_sha256 FROM f),
judged AS (SELECT *, CASE WHEN reason0 IS NULL AND row_number() OVER (PARTITION BY content_sha256, reason0 ORDER BY stock_code, page, place) > 1 THEN 'duplicate_content' ELSE reason0 END AS reason FROM j)"""
SQL = {
    "candidate_rejections": f"WITH {_JUDGED} SELECT coalesce(reason, 'candidate') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "candidate_rows": f"WITH {_JUDGED} SELECT page_id, stock_code, question_id, question, reply, day, content_sha256 FROM judged WHERE reason IS NULL",
}
