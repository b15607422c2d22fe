"""Tables that are changed without being rewritten: key buckets, bitmaps of deleted rows, a committed manifest.

Rows lie in folders by the hash of their key. An upsert rewrites the buckets that its keys fall into and no others; a
delete writes, for each data file that it hits, a bitmap of row positions that readers leave out. Neither touches a
file that is there. What counts is named by the manifest of the latest version, one file that Spark commits last:
a write that fails leaves the version before it, and of two writers of one version the second fails.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomshelf.operators.dimensions import upsert as merged

#: A data file within its write: files of one task have one name in all buckets.
FILE = r"regexp_extract(_metadata.file_path, '([^/]+/[^/]+)$', 1)"
MANIFEST = "bucket int, folder string, deletes array<string>, keys array<string>, buckets int"
#: Rows that one bitmap covers.
WORD = 1 << 15


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Manifest file by version; a version without its file was never committed."""
    try:
        files = spark.read.schema(MANIFEST).parquet(f"{path}/versions").inputFiles()
    except AnalysisException:
        return {}
    return {int(re.search(r"/version=(\d+)/", f)[1]): f for f in files}


def manifest(spark: SparkSession, path: str, version: int | None = None) -> list[Row]:
    """A row for each bucket that has rows: at most as many as there are buckets."""
    known = _versions(spark, path)
    if not known:
        raise ValueError(f"{path} has no committed version")
    return spark.read.schema(MANIFEST).parquet(known[max(known) if version is None else version]).collect()


def _commit(spark: SparkSession, path: str, entries: list[Row], version: int) -> None:
    rows = spark.createDataFrame(entries, MANIFEST).coalesce(1)  # one file: it is there or it is not
    rows.write.mode("errorifexists").parquet(f"{path}/versions/version={version}")


def _written(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> list[Row]:
    """Write rows by bucket into a folder of their own and name what was written."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    dealt = df.withColumn("_bucket", _bucket(keys, buckets))
    # large buckets are split over tasks, small ones share one
    dealt.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
    try:
        files = df.sparkSession.read.parquet(folder).inputFiles()
    except AnalysisException:  # no rows
        return []
    held = sorted({int(m[1]) for f in files if (m := re.search(r"/_bucket=(\d+)/", f))})
    return [Row(bucket=b, folder=f"{folder}/_bucket={b}", deletes=[], keys=list(keys), buckets=buckets) for b in held]


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """The first version of a table. ``keys`` name a row; NULL is a key like any other, but no change ever meets it."""
    spark = df.sparkSession
    if _versions(spark, path):
        raise ValueError(f"{path} is a table already")
    empty = df.limit(0)
    empty.write.parquet(f"{path}/schema")
    _commit(spark, path, _written(df, path, keys, buckets) or [Row(bucket=-1, folder=f"{path}/schema", deletes=[], keys=list(keys), buckets=buckets)], 1)


def _raw(spark: SparkSession, path: str, entries: list[Row]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(*[e["folder"] for e in entries]) if entries else spark.createDataFrame([], schema)


def _rows(spark: SparkSession, path: str, entries: list[Row]) -> DataFrame:
    """The rows of some buckets, without those that were deleted."""
    whole, cut = [e for e in entries if not e["deletes"]], [e for e in entries if e["deletes"]]
    out = _raw(spark, path, whole)
    if not cut:
        return out
    rows = _raw(spark, path, cut)
    columns = rows.columns
    placed = rows.select("*", F.expr(FILE).alias("_file"), F.col("_metadata.row_index").alias("_at"))
    marks = spark.read.parquet(*sorted({d for e in cut for d in e["deletes"]}))
    gone = marks.groupBy("_file", "_word").agg(F.bitmap_or_agg("_bits").alias("_bits")).select(F.col("_file").alias("_f"), F.col("_word").alias("_w"), "_bits")
    met = placed.join(gone, (F.col("_file") == F.col("_f")) & (F.expr(f"_at div {WORD}") == F.col("_w")), "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, CAST((_at % {WORD}) div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("1 << CAST(_at % 8 AS INT)").bitwiseAND(byte) != 0, F.lit(False))
    return out.unionByName(met.where(~hit).select(*columns))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its latest version, or of an earlier one."""
    return _rows(spark, path, manifest(spark, path, version))


def data_files(spark: SparkSession, path: str) -> dict[int, set[str]]:
    """Names of the data files of each bucket."""
    return {e["bucket"]: set(_raw(spark, path, [e]).inputFiles()) for e in manifest(spark, path)}


def _touched(rows: DataFrame, keys: Sequence[str], buckets: int) -> set[int]:
    """Buckets that some keys fall into; there are no more than the table has."""
    return {r["b"] for r in rows.select(_bucket(keys, buckets).alias("b")).distinct().collect()}


def _typed(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns that the table has too, in its types."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields if f.name in rows.columns])


def upsert(source: DataFrame, path: str) -> int:
    """Matched rows take every column that ``source`` has, NULLs included, the rest is inserted; the new version.

    Keys are unique in ``source``. Buckets that none of its keys falls into keep their files.
    """
    spark = source.sparkSession
    version, entries = max(_versions(spark, path)) + 1, manifest(spark, path)
    keys, buckets = entries[0]["keys"], entries[0]["buckets"]
    rows = _typed(source, _raw(spark, path, []))
    touched = _touched(rows, keys, buckets)
    old = _rows(spark, path, [e for e in entries if e["bucket"] in touched])
    new = _written(merged(old, rows, keys), path, keys, buckets)
    _commit(spark, path, [e for e in entries if e["bucket"] not in touched and e["bucket"] >= 0] + new or entries, version)
    return version


def delete(doomed: DataFrame, path: str) -> int:
    """Rows whose key is among ``doomed`` are left out from the new version on; no data file is written."""
    spark = doomed.sparkSession
    version, entries = max(_versions(spark, path)) + 1, manifest(spark, path)
    keys, buckets = entries[0]["keys"], entries[0]["buckets"]
    gone = _typed(doomed, _raw(spark, path, [])).select(*keys).distinct()
    touched = _touched(gone, keys, buckets)
    hit = [e for e in entries if e["bucket"] in touched]
    if not hit:
        return version - 1
    found = _raw(spark, path, hit).select(*keys, F.expr(FILE).alias("_file"), F.col("_metadata.row_index").alias("_at")).join(gone, list(keys), "left_semi")
    marks = found.groupBy("_file", F.expr(f"_at div {WORD}").alias("_word")).agg(F.bitmap_construct_agg(F.expr(f"_at % {WORD}")).alias("_bits"))
    folder = f"{path}/deletes/{uuid.uuid4().hex}"
    marks.write.parquet(folder)
    _commit(spark, path, [Row(**{**e.asDict(), "deletes": [*e["deletes"], folder]}) if e in hit else e for e in entries], version)
    return version


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite the buckets that have deleted rows without them; the others keep their files."""
    version, entries = max(_versions(spark, path)) + 1, manifest(spark, path)
    cut = [e for e in entries if e["deletes"]]
    if not cut:
        return version - 1
    keys, buckets = entries[0]["keys"], entries[0]["buckets"]
    new = _written(_rows(spark, path, cut), path, keys, buckets)
    left = [e for e in entries if not e["deletes"]] + new
    _commit(spark, path, left or [Row(bucket=-1, folder=f"{path}/schema", deletes=[], keys=keys, buckets=buckets)], version)
    return version
