"""What the operators share: stages in the shared folder, narrow views of a table, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without the setting gets one of its own."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomshelf-llm-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a stage and read it back: the lineage ends here and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled stage that no later plan reads."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame, text_col: str) -> Column:
    """The text as a string; NULL counts as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


#: Bits of the bitmap of ids in ``maybe_among``: 2 MB.
ID_BITS = 1 << 24


def maybe_among(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """A column ``_maybe``: whether the key may be among ``ids`` (one column). True for all that are, and for others by chance.

    A bitmap of ``ID_BITS`` bits goes to every task, so rows that cannot match need not be shuffled for the exact
    join that has to follow. Where ids are more than the bitmap can tell apart, more rows pass and nothing is lost.
    """
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(ID_BITS - 1))
    marks = ids.select(place(F.col(ids.columns[0])).alias("_place")).select(F.shiftright("_place", 15).alias("_bucket"), F.col("_place").bitwiseAND(F.lit(32767)).alias("_bit"))
    bitmaps = marks.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))  # 512 rows of 4 KB at most
    placed = df.withColumn("_place", place(key))
    met = placed.join(F.broadcast(bitmaps), F.shiftright("_place", 15) == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST((_place & 32767) >> 3 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("1 << CAST(_place & 7 AS INT)").bitwiseAND(byte) != 0, F.lit(False))
    return met.withColumn("_maybe", hit).drop("_place", "_bucket", "_bits")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Root (smallest member) of every node that has an edge: columns ``node``, ``root``.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). A round is two minimum-by-key
    aggregates, which combine before the shuffle, joined back to the edges, so a hub is split by the skew
    join. Each round is written to the shared folder; the number of rounds is logarithmic in practice.
    """
    now = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        # small star: every node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        then = settle(small, "edges")
        # the set of edges no longer changes once every node hangs on its root
        seen = then.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(now)
        now = then
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(seen)
