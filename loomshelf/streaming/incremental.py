"""Incremental variants of review loading and labelling as Structured Streaming jobs.

Every micro-batch is first written to a staging table, then loaded into partitions named after the
batch number and overwritten on replay, so a batch that runs twice leaves one copy. The streaming
checkpoint takes the place of a progress file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomshelf.functions.ranking import null_safe_join
from loomshelf.operators.dimensions import analysis_rows, key_reviews, new_members
from loomshelf.operators.labels import Labeller, explode_labels, label_reviews
from loomshelf.streaming import id_filters

REVIEW_KEY = ["product_code", "user_masked", "date", "text"]
#: Columns of the staged rows: digest of the text, which stands for it in joins and groups, and the place of the row.
DIGEST, PLACE = "_digest", "_place"

TABLES = {
    "users": "user_id bigint, user_masked string, batch_id bigint, bucket int",
    "user_ids": "user_id bigint, batch_id bigint",
    "reviews": "order_id bigint, product_code bigint, user_id bigint, write_date date, rating double, text string, "
    "image_count int, is_reorder boolean, batch_id bigint, write_month string",
    "review_ids": "order_id bigint, batch_id bigint",
}
REVIEW_COLUMNS = ["order_id", "product_code", "user_id", "write_date", "rating", "text", "image_count", "is_reorder"]


def read_drops(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a drop folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def _earlier(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """Rows of a loaded table written by earlier batches; an empty frame before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema).drop("batch_id")
    return spark.read.schema(schema).parquet(path).where(F.col("batch_id") < batch).drop("batch_id")


def _put(df: DataFrame, path: str, batch: int, *by: str) -> DataFrame:
    """Write a batch's partition and read it back."""
    target = f"{path}/batch_id={batch}"
    df.write.mode("overwrite").partitionBy(*by).parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def _drop(spark: SparkSession, path: str, batch: int) -> None:
    """Delete the staged copy of a batch that is loaded."""
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch}")
    staged.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged, True)


#: Folders that the users of each batch are dealt to, by the hash of their name.
USER_BUCKETS = 256


def _text_digest() -> Column:
    """SHA-256 of the text; a NULL text has none and meets no other, as NULL itself."""
    return F.unhex(F.sha2(F.col("text"), 256))


def _user_bucket() -> Column:
    return F.pmod(F.xxhash64("user_masked"), F.lit(USER_BUCKETS)).cast("int")


def known_users(spark: SparkSession, tables: str, rows: DataFrame, batch: int) -> DataFrame:
    """Users of earlier batches in the buckets of the users in ``rows``; other folders are not opened."""
    own = [r["b"] for r in rows.select(_user_bucket().alias("b")).distinct().collect()]  # at most one for each folder
    return _earlier(spark, f"{tables}/users", TABLES["users"], batch).where(F.col("bucket").isin(own) if own else F.lit(False)).drop("bucket")


def stream_reviews(
    reviews: DataFrame,
    tables: str,
    checkpoint: str,
    order_by: Sequence[str],
    buckets: Sequence[Column],
    lateness: str | None = None,
) -> DataStreamWriter:
    """Dedup, key and append crawled reviews.

    Copies inside a batch collapse to the first in ``order_by``; copies of loaded reviews are found by a
    join with the loaded rows of the batch's dates, however late they come. Reviews are kept in folders by
    month and users in folders by hash, so that join reads the months and the users' folders of the batch only, and
    the largest ids per batch in tables of their own, so numbering reads one row a batch. Copies are told by digests of
    the texts; a text moves once, to the row that stays, by its place in the staged batch. ``lateness`` adds a stateful
    filter in front that drops copies within a watermark sooner; which copy survives it is not defined.
    """
    unique = reviews
    if lateness is not None:
        unique = (
            reviews.withColumn("event_time", F.col("date").cast("timestamp"))
            .withWatermark("event_time", lateness)
            .dropDuplicatesWithinWatermark(REVIEW_KEY)
            .drop("event_time")
        )

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        staged = _put(batch.withColumns({DIGEST: _text_digest(), PLACE: F.monotonically_increasing_id()}), f"{tables}/_staging", number)
        old = {t: _earlier(spark, f"{tables}/{t}", TABLES[t], number) for t in TABLES if t != "users"}
        old["users"] = known_users(spark, tables, staged, number)
        first, last = staged.agg(F.min("date"), F.max("date")).first()
        if first is None:  # nothing with a date: nothing to compare with
            months = F.lit(False)
        else:
            months = F.col("write_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}") & F.col("write_date").between(F.lit(first), F.lit(last))
        same_days = old["reviews"].where(months).withColumn(DIGEST, _text_digest()).drop("text")
        loaded = same_days.join(old["users"], "user_id").select(
            "product_code", "user_masked", F.col("write_date").alias("date"), DIGEST
        )
        # no row carries its text through what follows
        fresh = staged.drop("text").join(loaded, [*REVIEW_KEY[:-1], DIGEST], "left_anti")
        # each table is written before the next is derived from it, so nothing is computed twice
        last = old["user_ids"].agg(F.max("user_id"))
        added = new_members(old["users"], fresh, "user_masked", "user_masked", "user_id", order_by, buckets, last)
        added = _put(added.withColumn("bucket", _user_bucket()), f"{tables}/users", number, "bucket").drop("bucket")
        _put(added.agg(F.max("user_id").alias("user_id")), f"{tables}/user_ids", number)
        users = old["users"].unionByName(added)
        keyed = key_reviews(fresh, users, old["review_ids"].agg(F.max("order_id")), order_by, buckets, [DIGEST, PLACE])
        # written first, so that a batch of known reviews is seen to be empty and moves no text
        keyed = _put(keyed, f"{tables}/_staging_ids", number)
        texts = keyed.join(staged.select(PLACE, "text"), PLACE).select(*REVIEW_COLUMNS)
        monthly = texts.withColumn("write_month", F.date_format("write_date", "yyyy-MM"))
        written = _put(monthly, f"{tables}/reviews", number, "write_month").drop("write_month")
        _put(written.agg(F.max("order_id").alias("order_id")), f"{tables}/review_ids", number)
        _put(analysis_rows(written), f"{tables}/review_analysis", number)
        _drop(spark, f"{tables}/_staging", number)
        _drop(spark, f"{tables}/_staging_ids", number)

    return unique.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)


LABELS = (
    "order_id bigint, product_code bigint, rating double, overall_sentiment string, sentiment_score double, aspect string, "
    "aspect_sentiment string, aspect_confidence double, aspect_reason string, evidence string, summary string, batch_id bigint"
)


#: Places of staged rows that one bitmap covers.
WORD = 1 << 15


def _first_copies(staged: DataFrame, done: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """The rows of ids that are not ``done``, of each id the first in the order of all its other columns.

    Copies are told apart by digests. Only ids whose copies differ bring their texts along to be put in order; which
    rows stay is then told by bitmaps of places, one bit a row, so that no other text is shuffled. ``stage`` writes what
    is joined to texts first, as Spark sees only then that it is small.
    """
    rest = [c for c in staged.columns if c not in ("order_id", DIGEST, PLACE)]
    narrow = staged.drop("text")
    alike = narrow.groupBy("order_id", *[c for c in rest if c != "text"], DIGEST).agg(F.min(PLACE).alias(PLACE))
    todo = alike.join(done, "order_id", "left_anti").select("order_id", PLACE)
    # the NULL id is a group like any other
    copies = stage(todo.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"), F.min(PLACE).alias(PLACE)), "copies")
    several = stage(copies.where("_n > 1").select("order_id"), "several")
    ordered = null_safe_join(staged, several, ["order_id"], "inner").groupBy("order_id").agg(F.min_by(PLACE, F.struct(*rest)).alias(PLACE))
    stay = copies.where("_n = 1").select(PLACE).unionByName(ordered.select(PLACE))
    marks = stay.groupBy(F.expr(f"{PLACE} div {WORD}").alias("_word")).agg(F.bitmap_construct_agg(F.col(PLACE) % WORD).alias("_bits"))
    marks = stage(marks, "marks")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, CAST(({PLACE} % {WORD}) div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    placed = staged.join(marks, F.expr(f"{PLACE} div {WORD}") == F.col("_word"))
    return placed.where(F.expr(f"1 << CAST({PLACE} % 8 AS INT)").bitwiseAND(byte) != 0).drop("_word", "_bits")


def stream_labels(reviews: DataFrame, labels: str, checkpoint: str, labeller: Labeller | None = None) -> DataStreamWriter:
    """Label reviews that have no label yet, each once even if its batch holds it twice; one row per review and aspect.

    Which reviews are labelled is told by the filters beside the labels (``id_filters``): a batch opens the ids of
    those earlier batches only that may hold one of its own, and no label.
    """
    columns = [c.split()[0] for c in LABELS.split(", ") if not c.startswith("batch_id")]

    def load(batch: DataFrame, number: int) -> None:
        staged = _put(batch.withColumns({DIGEST: _text_digest(), PLACE: F.monotonically_increasing_id()}), f"{labels}_staging", number)
        done = id_filters.handled(staged, "order_id", f"{labels}_handled", number)
        todo = _first_copies(staged, done, lambda df, name: _put(df, f"{labels}_{name}", number)).drop(DIGEST, PLACE)
        written = _put(explode_labels(label_reviews(todo, labeller)).select(*columns), labels, number)
        # only now, so that a batch that failed before is labelled when it runs again
        id_filters.remember(written, "order_id", f"{labels}_handled", number)
        for name in ("staging", "copies", "several", "marks"):
            _drop(batch.sparkSession, f"{labels}_{name}", number)

    return reviews.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
