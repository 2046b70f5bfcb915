"""Readers and writers of tables: explicit schemas, blanks are nulls, missing files are empty tables where asked."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, missing_ok: bool = True) -> DataFrame:
    """CSV with a header, quoted line feeds and doubled quotes.  The schema is never inferred, so codes keep their zeros."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
    try:
        return reader.csv(path)
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_csv(df: DataFrame, path: str, fields: list[str], digits: int | None = None) -> None:
    """The named fields; booleans as true and false, floats with ``digits`` decimals if given."""
    def shown(c: str):
        kind = df.schema[c].dataType
        if isinstance(kind, T.BooleanType):
            return F.when(F.col(c), "true").when(~F.col(c), "false").alias(c)
        if digits is not None and isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.format_string(f"%.{digits}f", F.col(c)).alias(c)
        return F.col(c)

    df.select(*[shown(f) for f in fields]).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a line; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest_records(df: DataFrame, key: list[str], stamp: str = "generated_at", line: str = "line_no") -> DataFrame:
    """The newest record of each key; the later line wins ties."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(stamp, line)).alias("r")).select("r.*")


def usable_annotations(records: DataFrame, documents: DataFrame, version: str) -> DataFrame:
    """Newest successful records of a prompt version, with confidences capped by their documents' reliability."""
    good = latest_records(records, ["cache_key"]).filter((F.col("status") == "success") & (F.col("prompt_version") == version))
    met = good.join(documents.select("doc_id", "confidence_cap"), "doc_id")
    return met.withColumn("predicates", F.transform("predicates", lambda p: p.withField("confidence", F.least(p["confidence"], F.col("confidence_cap")))))


def failure_category(reason, words: list[tuple[str, str]] = [("timeout", "timeout"), ("json", "invalid_json"), ("schema", "schema"), ("evidence", "evidence"), ("429", "rate_limit")]):
    """The category of the first word that a failure's reason holds."""
    out = F.lit("other")
    for word, name in reversed(words):
        out = F.when(F.contains(F.lower(reason), F.lit(word)), name).otherwise(out)
    return F.when(reason.isNull() | (reason == ""), "none").otherwise(out)


def parse_bars(raw: DataFrame, variety: str, body: str = "body") -> DataFrame:
    """Daily contract rows from exchange JSON (trade_date, body): one variety, six-character contracts, positive prices."""
    rows = F.from_json(body, "struct<data:array<struct<variety:string,delivMonth:string,open:string,high:string,low:string,close:string,clearPrice:string,volumn:string,openInterest:string>>>")
    each = raw.select("trade_date", F.explode(F.col("__j.data") if "__j" in raw.columns else rows["data"]).alias("r"))
    price = lambda c: F.col(f"r.{c}").try_cast("double")
    out = each.filter(F.lower("r.variety") == variety.lower()).select("trade_date", F.upper(F.concat(F.lit(variety), "r.delivMonth")).alias("contract"), price("open").alias("open"), price("high").alias("high"), price("low").alias("low"), price("close").alias("close"), price("clearPrice").alias("settlement"), price("volumn").alias("volume"), price("openInterest").alias("open_interest"))
    return out.filter((F.length("contract") == 6) & (F.least("open", "high", "low", "close") > 0))


def warehouse_total(rows: DataFrame) -> DataFrame:
    """Receipts of each day and variety: the subtotal row if there is one, else the sum of the numbered warehouses."""
    numbered = F.col("warehouse").rlike(r"^\d+$")
    return rows.groupBy("trade_date", "variety").agg(F.coalesce(F.max(F.when(F.col("is_subtotal"), F.col("receipts"))), F.sum(F.when(numbered, F.col("receipts")))).alias("warehouse_receipt"))
