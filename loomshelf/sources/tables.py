"""Writing and reading of tables: append, replace, upsert by rewrite, exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshelf.operators.dimensions import upsert

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster.

    Only a local session without the setting gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="loomshelf-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage through a written table that outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def insert(df: DataFrame, path: str, if_exists: str = "append", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode({"append": "append", "replace": "overwrite"}[if_exists])
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert_table(spark: SparkSession, current: str, source: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Upsert into a Parquet table by writing a new version; the version being read is never overwritten."""
    upsert(spark.read.parquet(current), source, keys).write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def truncate(spark: SparkSession, path: str) -> None:
    """Empty a table and keep its columns."""
    empty = spark.createDataFrame([], spark.read.parquet(path).schema)
    empty.write.mode("overwrite").parquet(path)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def schema_listing(df: DataFrame) -> DataFrame:
    """Column names and types, from the plan's schema alone."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string, nullable boolean")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def training_rows(reviews: DataFrame, min_length: int = 10) -> DataFrame:
    return reviews.where(F.length("text") >= min_length).select("order_id", "product_code", "text", "rating")


def export_training(reviews: DataFrame, path: str, min_length: int = 10) -> None:
    """CSV with header and quoting that survives line breaks inside texts."""
    rows = training_rows(reviews, min_length)
    rows.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_with_ambiguous(results: DataFrame, flag: str, path: str, ambiguous_path: str) -> None:
    """All results, and the ambiguous rows once more on their own.

    The second output is read back from the first, so the work before it runs once without pinning
    rows in executor memory.
    """
    results.write.mode("errorifexists").parquet(path)
    results.sparkSession.read.parquet(path).where(F.col(flag)).write.mode("errorifexists").parquet(ambiguous_path)
