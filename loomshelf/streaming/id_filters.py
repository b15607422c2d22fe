"""Which ids earlier batches have handled, without reading them: Bloom filters by id range, kept beside the ids.

Every batch leaves its ids in a folder for each range, and for each range a Bloom filter whose size follows the number
of ids. A later batch tests its ids against the filters of their ranges and opens the ids of those batches and
ranges alone that a filter names, to look its hits up exactly.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of a range; bits of a filter for each id, rounded up to a power of two; bits that each id sets.
RANGE, BITS_PER_ID, PLACES = 1 << 20, 16, 2
WORD = 1 << 15
FILTERS = "size bigint, word bigint, bits binary, batch_id bigint, id_range bigint"
IDS = "id bigint, batch_id bigint, id_range bigint"


def _range(key: str) -> Column:
    return F.floor(F.col(key) / RANGE).cast("long")


def _with_places(ids: DataFrame) -> DataFrame:
    """A row for each bit of each id in a filter of ``size`` bits: ``word`` and ``bit``."""
    places = F.array(*[F.xxhash64("id", F.lit(k)).bitwiseAND(F.col("size") - 1) for k in range(PLACES)])
    placed = ids.withColumn("_place", F.explode(places))
    return placed.withColumns({"word": F.expr(f"_place div {WORD}"), "bit": F.col("_place") % WORD}).drop("_place")


def remember(ids: DataFrame, key: str, root: str, batch: int) -> None:
    """Write the ids of a batch and their filters. A batch that runs again overwrites its own."""
    ranged = ids.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").distinct().withColumn("id_range", _range("id"))
    ranged.write.mode("overwrite").partitionBy("id_range").parquet(f"{root}/ids/batch_id={batch}")
    try:
        ranged = ids.sparkSession.read.schema("id bigint, id_range bigint").parquet(f"{root}/ids/batch_id={batch}")
    except AnalysisException:  # no ids
        return
    least = F.lit(float(WORD))
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.count(F.lit(1)) * float(BITS_PER_ID), least)))).cast("long")
    placed = _with_places(ranged.join(ranged.groupBy("id_range").agg(size.alias("size")), "id_range"))
    filters = placed.groupBy("id_range", "size", "word").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filters.write.mode("overwrite").partitionBy("id_range").parquet(f"{root}/filters/batch_id={batch}")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing is stored yet
        return None


def named_folders(ids: DataFrame, key: str, root: str, batch: int) -> list[str]:
    """Folders of earlier batches that may hold some of the ids, by the filters of the ids' ranges."""
    filters = _stored(ids.sparkSession, f"{root}/filters", FILTERS)
    mine = ids.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").distinct().withColumn("id_range", _range("id"))
    if filters is None:
        return []
    ranges = [r["id_range"] for r in mine.select("id_range").distinct().collect()]  # folders, not ids
    filters = filters.where(F.col("id_range").isin(ranges) & (F.col("batch_id") < batch)) if ranges else filters.where("false")
    heads = filters.select("batch_id", "id_range", "size").distinct()
    placed = _with_places(mine.join(heads, "id_range"))
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    tested = placed.join(filters.select("batch_id", "id_range", "word", "bits"), ["batch_id", "id_range", "word"]).where(F.expr("1 << CAST(bit % 8 AS INT)").bitwiseAND(byte) != 0)
    hits = tested.groupBy("batch_id", "id_range", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == PLACES)
    return sorted(f"{root}/ids/batch_id={r['batch_id']}/id_range={r['id_range']}" for r in hits.select("batch_id", "id_range").distinct().collect())


def handled(ids: DataFrame, key: str, root: str, batch: int) -> DataFrame:
    """Those of the ids that earlier batches have handled, one row each, looked up in the named folders only."""
    folders = named_folders(ids, key, root, batch)
    stored = ids.sparkSession.read.schema("id bigint").parquet(*folders) if folders else ids.sparkSession.createDataFrame([], "id bigint")
    return ids.select(F.col(key).cast("long").alias(key)).distinct().join(stored, F.col(key) == F.col("id"), "left_semi")
