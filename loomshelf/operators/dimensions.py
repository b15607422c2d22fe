"""Keys and loading: surrogate ids, upserts, splitting crawled files into the star schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.functions.columns import steps_below
from loomshelf.functions.quantiles import with_row
from loomshelf.functions.ranking import bucketed_row_number, keep_first, null_safe_join

# Length bins of the analysis table.
ANALYSIS_LENGTH_BINS = [(20, "very_short"), (50, "short"), (100, "medium"), (500, "long")]
ANALYSIS_LONGEST = "very_long"


def lookup_id(df: DataFrame, dim: DataFrame, name: str, dim_name: str, dim_id: str) -> DataFrame:
    """Attach the surrogate id of a name; unknown names get NULL. Small dimensions are broadcast by size."""
    ids = dim.select(F.col(dim_name).alias("_name"), dim_id)
    return df.join(ids, F.col(name) == F.col("_name"), "left").drop("_name")


def new_members(
    dim: DataFrame, incoming: DataFrame, name: str, dim_name: str, dim_id: str, order_by: Sequence[str], buckets: Sequence[Column], last: DataFrame | None = None
) -> DataFrame:
    """Names not yet in the dimension with ids max+1, max+2, … in order of first appearance.

    ``last`` (one row, one column) gives the maximum where ``dim`` holds only the part that names are looked up in.

    ``buckets`` are expressions over ``order_by`` columns that rise along the order, so that ranking
    a large member set is spread over tasks.
    """
    first = (
        incoming.where(F.col(name).isNotNull() & (F.col(name) != ""))
        .groupBy(F.col(name).alias(dim_name))
        .agg(F.min(F.struct(*order_by)).alias("_first"))
        .select(dim_name, "_first.*")
    )
    unseen = first.join(dim.select(dim_name), dim_name, "left_anti")
    ranked = bucketed_row_number(unseen, [*order_by, dim_name], buckets, name="_rn")
    last = dim.agg(F.max(dim_id)) if last is None else last
    last = last.toDF("_max").select(F.coalesce(F.col("_max").cast("long"), F.lit(0).cast("long")).alias("_max"))
    return with_row(ranked, last).select((F.col("_max") + F.col("_rn")).alias(dim_id), dim_name)


def register_members(dim: DataFrame, incoming: DataFrame, name: str, dim_name: str, dim_id: str, order_by, buckets) -> DataFrame:
    """The dimension with unseen names appended; their other attributes are NULL."""
    added = new_members(dim, incoming, name, dim_name, dim_id, order_by, buckets)
    return dim.withColumn(dim_id, F.col(dim_id).cast("long")).unionByName(added, allowMissingColumns=True)


def assign_ids(df: DataFrame, last: DataFrame, order_by: Sequence[str], buckets: Sequence[Column], name: str = "order_id") -> DataFrame:
    """Gap-free ids that continue after the maximum in ``last`` (one row, one column)."""
    numbered = bucketed_row_number(df, order_by, buckets, name="_rn")
    return (
        with_row(numbered, last.toDF("_last"))
        .withColumn(name, F.coalesce(F.col("_last"), F.lit(0)).cast("long") + F.col("_rn"))
        .drop("_rn", "_last")
    )


def user_keys(users: DataFrame, order_by: Sequence[str], buckets: Sequence[Column]) -> DataFrame:
    """Masked user names → user_0001, user_0002, … by first sight."""
    first = users.groupBy("user_masked").agg(F.min(F.struct(*order_by)).alias("_first")).select("user_masked", "_first.*")
    ranked = bucketed_row_number(first, [*order_by, "user_masked"], buckets)
    return ranked.select("user_masked", F.format_string("user_%04d", "rn").alias("user"))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched rows take every non-key column the source has, NULLs included; the rest is inserted."""
    src = source.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys],
        F.lit(True).alias("_in_source"),
    )
    on = None
    for k in keys:
        part = target[k] == F.col(f"_k_{k}")
        on = part if on is None else on & part
    joined = target.join(src, on, "full_outer")
    hit = F.col("_in_source").isNotNull()

    def pick(c: str) -> Column:
        kept = target[c]
        if c in keys:
            return F.coalesce(kept, F.col(f"_k_{c}")).alias(c)
        if c in source.columns:
            return F.when(hit, F.col(f"_s_{c}")).otherwise(kept).alias(c)
        return kept.alias(c)

    return joined.select(*[pick(c) for c in target.columns])


def delete_by_key(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def split_products(crawl: DataFrame, columns: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One wide product file as several tables; columns the file lacks are NULL."""

    def project(names: Sequence[str]) -> DataFrame:
        return crawl.select(*[F.col(n) if n in crawl.columns else F.lit(None).alias(n) for n in names])

    return {table: project(names) for table, names in columns.items()}


def load_products(targets: dict[str, DataFrame], crawl: DataFrame, order_by: Sequence[str]) -> dict[str, DataFrame]:
    """Keep the first row per product, split by the targets' columns and upsert each table."""
    first = keep_first(crawl, ["product_code"], order_by)
    out = {}
    for name, part in split_products(first, {t: df.columns for t, df in targets.items()}).items():
        present = [c for c in part.columns if c in crawl.columns]
        out[name] = upsert(targets[name], part.select(*present), ["product_code"])
    return out


def analysis_length_class(length: str) -> Column:
    """Bins (0,20] (20,50] (50,100] (100,500] (500,∞); a length of 0 has none."""
    return F.when(F.col(length) > 0, steps_below(length, ANALYSIS_LENGTH_BINS, ANALYSIS_LONGEST))


def key_reviews(
    crawl: DataFrame, users: DataFrame, last: DataFrame, order_by: Sequence[str], buckets: Sequence[Column], text: Sequence[str] = ("text",)
) -> DataFrame:
    """Crawled rows as review rows: known user, first copy only, ids after ``last`` (one row, one column).

    ``text`` names the columns that stand for the text, which may be its digest and the place it is read from; the
    first of them tells copies.
    """
    keyed = lookup_id(crawl, users.select("user_masked", "user_id"), "user_masked", "user_masked", "user_id")
    if "is_reorder" not in crawl.columns:
        keyed = keyed.withColumn("is_reorder", F.lit(False))
    unique = keep_first(keyed, ["product_code", "user_id", "date", text[0]], order_by)
    return assign_ids(unique, last, order_by, buckets).select(
        "order_id",
        "product_code",
        "user_id",
        F.col("date").cast("date").alias("write_date"),
        "rating",
        *text,
        "image_count",
        F.coalesce("is_reorder", F.lit(False)).alias("is_reorder"),
    )


def analysis_rows(reviews: DataFrame) -> DataFrame:
    """Length and length class of every review."""
    lengths = reviews.select("order_id", F.length(F.coalesce("text", F.lit(""))).alias("length"))
    return lengths.withColumn("length_category", analysis_length_class("length"))


def load_reviews(
    reviews: DataFrame,
    analysis: DataFrame,
    users: DataFrame,
    crawl: DataFrame,
    order_by: Sequence[str],
    buckets: Sequence[Column],
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """Crawled reviews → users, reviews and review_analysis rows to append.

    Each table is derived from the one before; ``stage`` writes a table once before the next reads it.
    Expects ``user_masked, product_code, date, text, rating, image_count`` and the order columns.
    """
    all_users = stage(register_members(users, crawl, "user_masked", "user_masked", "user_id", order_by, buckets))
    fresh = stage(key_reviews(crawl, all_users, reviews.agg(F.max("order_id")), order_by, buckets))
    lengths = analysis.limit(0).unionByName(analysis_rows(fresh), allowMissingColumns=True)
    return {"users": all_users, "reviews": fresh, "review_analysis": lengths}


def product_ingredients(
    rows: DataFrame, master: DataFrame, product: str, name: str, order_by: Sequence[str], buckets: Sequence[Column]
) -> DataFrame:
    """Ranked ingredient ids per product; unknown names are dropped before the upsert, ranks stay as listed."""
    ranked = bucketed_row_number(rows, order_by, buckets, keys=[product], name="rank")
    keyed = lookup_id(ranked, master, name, "name", "ingredient_id").where(F.col("ingredient_id").isNotNull())
    return keep_first(keyed.select(product, "ingredient_id", "rank"), [product, "ingredient_id"], ["rank"])


def overlay_verdicts(attributes: DataFrame, rows: DataFrame, order_by: Sequence[str], verdicts=("can_halal", "can_vegan")) -> DataFrame:
    """First non-null verdict per product laid over the attributes where there is one."""
    order = F.struct(*order_by)
    new = rows.groupBy("product_code").agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_new_{c}") for c in verdicts]
    )
    joined = attributes.join(new, "product_code", "left")
    for c in verdicts:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return joined


def distribute_columns(
    products: DataFrame,
    reviews: DataFrame,
    wide: DataFrame,
    product_columns: Sequence[str],
    review_columns: Sequence[str],
    order_by: Sequence[str],
) -> dict[str, DataFrame]:
    """Spread columns of one wide file over the product and the review table, first row per key."""
    p = keep_first(wide.select("product_code", *product_columns, *order_by), ["product_code"], order_by).drop(*order_by)
    with_order = wide.where(F.col("order_id").isNotNull()).withColumn("order_id", F.col("order_id").cast("long"))
    keep = [c for c in order_by if c != "order_id"]
    r = keep_first(with_order.select("order_id", *review_columns, *keep), ["order_id"], keep).drop(*keep)
    return {"products": products.join(p, "product_code", "left"), "reviews": reviews.join(r, "order_id", "left")}


def match_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Matched rows and NULL percentage per added column."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(c).alias(f"_m{i}") for i, c in enumerate(columns)]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_m{i}").alias("n_matched"),
            ((F.col("_n") - F.col(f"_m{i}")) * 100.0 / F.nullif(F.col("_n"), F.lit(0))).alias("null_pct"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def add_missing_ingredients(existing: DataFrame, extra: DataFrame, products: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Extra rows only for products that have none yet; unknown products get a placeholder name."""
    known = existing.select("product_id").distinct()
    names = products.select(F.col("product_code").alias("product_id"), F.col("name").alias("_known"))
    fresh = (
        extra.join(known, "product_id", "left_anti")
        .join(names, "product_id", "left")
        .withColumn("name", F.coalesce("_known", F.format_string("(product %s)", F.col("product_id").cast("string"))))
        .drop("_known")
    )
    merged = existing.unionByName(fresh, allowMissingColumns=True)
    return keep_first(merged, ["product_id", "name", "ingredient"], order_by)


def unanalysed(
    reviews: DataFrame,
    analysis: DataFrame,
    min_length: int = 10,
    products: Sequence[int] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Reviews without a sentiment; an analysis row with NULL sentiment counts as not analysed."""
    kept = reviews.where(F.length("text") >= min_length)
    if products is not None:
        kept = kept.where(F.col("product_code").isin(*products))
    done = analysis.where(F.col("sentiment").isNotNull()).select("order_id")
    todo = kept.join(done, "order_id", "left_anti")
    return todo.orderBy("order_id").limit(limit) if limit is not None else todo


def write_back(analysis: DataFrame, labels: DataFrame) -> DataFrame:
    """Set sentiment and score per review, leave every other column."""
    return upsert(analysis, labels.select("order_id", "sentiment", "sentiment_score"), ["order_id"])


def progress(reviews: DataFrame, analysis: DataFrame, sentiments: Sequence[str] = ("positive", "neutral", "negative")) -> DataFrame:
    """Total, analysed, not analysed, and count and share per sentiment, in one row."""
    joined = reviews.select("order_id").join(analysis.select("order_id", "sentiment"), "order_id", "left")
    s = F.col("sentiment")
    done = F.count_if(s.isNotNull())
    out = joined.agg(
        F.count(F.lit(1)).alias("total"),
        done.alias("analysed"),
        F.count_if(s.isNull()).alias("not_analysed"),
        *[F.count_if(s == v).alias(f"n_{v}") for v in sentiments],
    )
    return out.select("*", *[(F.col(f"n_{v}") * 100.0 / F.nullif(F.col("analysed"), F.lit(0))).alias(f"pct_{v}") for v in sentiments])
