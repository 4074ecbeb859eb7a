"""Labelled offers in JSON lines, and the row codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFER = "id string, source string, title string, text string, price string, url string, temperature int, timestamp string, metadata map<string,string>"
LINE = f"{OFFER}, relevant boolean, promotion struct<{', '.join(f.replace(' ', ':', 1) for f in OFFER.split(', '))}>"


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """The fields of OFFER, price as decimal and timestamp parsed, and relevant. Offers may be nested under `promotion`;
    blank lines count for nothing; a line that is not JSON, or lacks its label, fails the job with the line's text."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", LINE, {"mode": "PERMISSIVE"})
    j = lines.select("value", row.alias("r"))
    j = j.filter(F.coalesce(F.col("r.relevant").isNotNull(), F.lit(False)) | F.raise_error(F.concat(F.lit("not a labelled offer: "), F.left("value", F.lit(200)))).cast("boolean"))
    names = [f.split()[0] for f in OFFER.split(", ")]
    flat = j.select(*[F.coalesce(f"r.promotion.{n}", f"r.{n}").alias(n) for n in names], "r.relevant")
    return flat.withColumns({"price": F.col("price").cast("decimal(18,2)"), "timestamp": F.to_timestamp("timestamp")})


def encoded(offers: DataFrame) -> DataFrame:
    """One JSON text a row, nulls written out."""
    return offers.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
