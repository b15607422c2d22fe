"""Readers of crawled files and model responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.functions.ranking import keep_first
from loomshelf.schemas import LABEL_SCHEMA

BOM = "﻿"


def category_of(path: Column, kind: str = "product") -> Column:
    """``product_<category>.csv``, a file or a folder of parts → category."""
    return F.regexp_extract(path, rf"{kind}_([^/]+)\.csv(?:/part-[^/]*)?$", 1)


def read_category_csv(spark: SparkSession, pattern: str, schema: str, kind: str = "product", category: str = "category") -> DataFrame:
    """All CSV files of a pattern, each row tagged with the category in its file name and its file.

    The schema names the columns, so a byte-order mark in a header line does no harm.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(pattern)
    )
    path = F.url_decode(F.col("_metadata.file_path"))
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), category_of(path, kind).alias(category))


def strip_bom(df: DataFrame) -> DataFrame:
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip(BOM))


def union_parts(parts: Sequence[DataFrame], keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Union by column name (missing columns NULL) and keep the first row per key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_first(out, keys, order_by)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lines; a line that is no JSON object becomes a row of NULLs and is dropped."""
    return spark.read.schema(LABEL_SCHEMA).json(path).where(F.col("index").isNotNull())


RESPONSE_SCHEMA = (
    "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>, "
    "error struct<message:string>"
)
CONTENT_SCHEMA = (
    "sentiment string, sentiment_score double, aspect_labels array<struct<aspect:string,sentiment:string,confidence:double,reason:string>>, "
    "evidence string, summary string"
)


def parse_responses(lines: DataFrame, line: str = "value", content_schema: str = CONTENT_SCHEMA) -> DataFrame:
    """Model response lines → one row each: id, parsed content, success flag and error text.

    Parsing is permissive twice (the envelope and the JSON text inside it); whatever cannot be read is
    a failure row and not an error of the job.
    """
    outer = lines.select(F.from_json(line, RESPONSE_SCHEMA).alias("_r"))
    content = F.get(F.col("_r.response.body.choices"), F.lit(0))["message"]["content"]
    inner = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    status = F.col("_r.response.status_code")
    parsed = outer.select(
        F.regexp_extract(F.col("_r.custom_id"), r"(\d+)$", 1).try_cast("long").alias("idx"),
        status.alias("status_code"),
        F.when(status == 200, F.from_json(inner, content_schema)).alias("label"),
        F.col("_r.error.message").alias("_message"),
    )
    ok = F.col("label").isNotNull() & F.col("label.sentiment").isNotNull()
    code = F.col("status_code")
    reason = F.coalesce(F.col("_message"), F.concat(F.lit("status "), F.coalesce(code.cast("string"), F.lit("missing"))))
    why = F.when(F.coalesce(code, F.lit(-1)) != 200, reason)
    return parsed.select(
        "idx", "label.*", ok.alias("success"), F.when(~ok, F.coalesce(why, F.lit("content is not valid JSON"))).alias("error")
    )


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return parse_responses(spark.read.text(path))


def parse_bullets(lines: DataFrame) -> DataFrame:
    """A line holding a number opens a product block; the bullet lines below it are its ingredients.

    ``lines(file, block, row, value)`` are ordered by block, then row, inside a file. Every bullet belongs
    to the nearest number line above it. Only blocks are sorted; the last opener of each block is
    carried forward over a frame of one row per block.
    """
    text = F.trim("value")
    tagged = lines.select(
        "file",
        "block",
        "row",
        F.when(text.rlike(r"^\d+$"), text.cast("long")).alias("_opens"),
        F.when(text.startswith("•"), F.trim(F.regexp_replace(text, "^•+", ""))).alias("ingredient"),
    )
    ends = tagged.groupBy("file", "block").agg(
        F.max_by("_opens", F.when(F.col("_opens").isNotNull(), F.col("row"))).alias("_last")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    upto = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        tagged.withColumn("_own", F.last("_opens", ignorenulls=True).over(upto))
        .join(carried, ["file", "block"])
        .select("file", "block", "row", F.coalesce("_own", "_carried").alias("product_id"), "ingredient")
        .where((F.col("ingredient") != "") & F.col("product_id").isNotNull())
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with file, block and row. A block is the byte range one task reads front to back, so
    the generated id rises along its lines and large files stay splittable."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
