"""Cleaning, key reconciliation and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.functions.columns import any_of, col, ratio
from loomshelf.functions.quantiles import small_domain_quantiles, with_row
from loomshelf.functions.ranking import keep_first

# Dedup keys, character classes, limits and names of the quality reports.
DEDUP_KEYS = {
    "products": ["product_code"],
    "reviews": ["user", "product_code", "date", "text"],
    "ingredients": ["product_id", "name", "ingredient"],
    "analysis": ["order_id"],
}
TARGET_SCRIPT = "[가-힣ㄱ-ㅎㅏ-ㅣ]"
OTHER_SCRIPTS = "[a-zA-Z぀-ゟ゠-ヿ一-鿿]"
WORD_SCRIPT = "[가-힣]"
FILLER_SCRIPT = "[ㄱ-ㅎㅏ-ㅣ]"
MIN_SCRIPT_SHARE = 0.3
COUNT_BINS = [10, 20, 30, 40, 50, 60, 80, 100]
TOOL_CATEGORIES = ["메이크업 브러쉬", "메이크업 퍼프", "메이크업 소품", "퍼프브러시세척"]
TOOL_BRAND = "다이소"


def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep the first row per key in a stated order."""
    return keep_first(df, keys, order_by)


def text_digest(text: str = "text") -> Column:
    """128 bits of a text in two numbers: fixed width, so copies collapse in hash aggregates."""
    digest = F.md5(text)
    return F.struct(*[F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint").alias(n) for at, n in ((1, "hi"), (17, "lo"))])


def dedup_by_text(df: DataFrame, text: str, key: str) -> DataFrame:
    """The row with the smallest ``key`` of each text; ``key`` is a number, unique among the rows.

    Only digests and keys are grouped; the texts of the rows that stay come by a join on the key.
    """
    first = df.select(text_digest(text).alias("_d"), F.col(key).alias("_k")).groupBy("_d.hi", "_d.lo").agg(F.min("_k").alias("_k"))
    return df.join(first.select("_k"), df[key] == F.col("_k"), "left_semi")


def reconcile_keys(left: DataFrame, right: DataFrame, category: str, key: str) -> DataFrame:
    """For every key, whether both sides or only one of them knows it."""
    a = left.select(category, key).distinct().withColumn("_l", F.lit(True))
    b = right.select(category, key).distinct().withColumn("_r", F.lit(True))
    status = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "only_left").otherwise("only_right")
    return a.join(b, [category, key], "full_outer").select(category, key, status.alias("status"))


def reconcile_counts(reconciled: DataFrame, category: str) -> DataFrame:
    return reconciled.groupBy(category, "status").agg(F.count(F.lit(1)).alias("n_keys"))


def orphan_reviews(reviews: DataFrame, products: DataFrame, key: str = "product_code") -> DataFrame:
    """Reviews whose product is unknown, counted per product (counted first, so a hot product is one row)."""
    counts = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews"))
    return counts.join(products.select(key), key, "left_anti")


def silent_products(products: DataFrame, reviews: DataFrame, key: str = "product_code") -> DataFrame:
    """Products nobody reviewed, with their details."""
    return products.join(reviews.select(key).distinct(), key, "left_anti")


def file_pairs(files: DataFrame, path: str = "path", left: str = "product", right: str = "reviews") -> DataFrame:
    """Which categories have a product file, a review file, or both."""
    pattern = rf"({left}|{right})_([^/]+)\.csv$"
    parsed = files.select(
        F.regexp_extract(path, pattern, 1).alias("kind"), F.regexp_extract(path, pattern, 2).alias("category")
    ).where(F.col("kind") != "")
    seen = parsed.groupBy("category").agg(
        F.max(F.col("kind") == left).alias("has_products"), F.max(F.col("kind") == right).alias("has_reviews")
    )
    return seen.withColumn("complete", F.col("has_products") & F.col("has_reviews"))


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL and blank counts per column, from a single aggregation."""
    columns = list(columns or df.columns)
    text = {n for n, t in df.dtypes if t == "string"}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"_null{i}"))
        blank = F.count_if(F.trim(c) == "") if c in text else F.lit(0).cast("long")
        aggs.append(blank.alias(f"_blank{i}"))
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"_null{i}").alias("n_null"), F.col(f"_blank{i}").alias("n_blank"), F.col("_n").alias("n_rows"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def iqr_outliers(sizes: DataFrame, value: str = "n", factor: float = 1.5) -> DataFrame:
    """Groups outside Q1 - f·IQR … Q3 + f·IQR.

    Different counts are few however many groups there are, so the quartile map stays small.
    """
    cuts = small_domain_quantiles(sizes, value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    bounds = cuts.select((F.col("q1") - factor * spread).alias("lower"), (F.col("q3") + factor * spread).alias("upper"))
    kind = F.when(F.col(value) < F.col("lower"), "low").when(F.col(value) > F.col("upper"), "high")
    return with_row(sizes, bounds).withColumn("kind", kind).where(F.col("kind").isNotNull())


def histogram(sizes: DataFrame, value: str = "n", edges: Sequence[int] = COUNT_BINS) -> DataFrame:
    """Right-closed bins (a, b]; the first starts above 0 and the last is open."""
    low = 0
    label = F
    for edge in edges:
        label = label.when((F.col(value) > low) & (F.col(value) <= edge), F.lit(f"({low},{edge}]"))
        low = edge
    label = label.when(F.col(value) > low, F.lit(f"({low},inf)"))
    return sizes.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n_groups"))


def duplicate_pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def extreme_groups(
    df: DataFrame, key: str, name: str, order_by: Sequence[str], low: int = 10, high: int = 60
) -> DataFrame:
    """Groups with very few or very many rows and the name of their first row."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(name, F.struct(*order_by)).alias("name"))
    kind = F.when(F.col("n") < low, "low").when(F.col("n") > high, "high")
    return sizes.withColumn("kind", kind).where(F.col("kind").isNotNull())


def copied_texts(reviews: DataFrame, min_products: int = 2, min_rows: int = 2, key: str = "order_id") -> DataFrame:
    """Texts pasted under several products.

    Rows are reduced to digests and counted per (digest, product, user, rating) before anything else; each
    distinct count groups the next smaller table. The text itself is fetched by the smallest ``key`` of the
    digests that survive.
    """
    d = ["hi", "lo"]
    rows = reviews.where(F.col("text").isNotNull()).select(text_digest().alias("_d"), "product_code", "user_id", F.col("rating").cast("int").alias("rating"), F.col(key).alias("_k"))
    cells = rows.groupBy("_d.hi", "_d.lo", "product_code", "user_id", "rating").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_k"))

    def distinct(column: str, name: str) -> DataFrame:
        # a NULL is no value
        pairs = cells.where(F.col(column).isNotNull()).select(*d, column).distinct()
        return pairs.groupBy(*d).agg(F.count(F.lit(1)).alias(name))

    # a rating has a handful of values, so the set is bounded
    ratings = F.array_join(F.array_sort(F.collect_set(F.col("rating").cast("string"))), ",").alias("ratings")
    totals = cells.groupBy(*d).agg(F.sum("_n").alias("n_rows"), F.min("_k").alias("_k")).where(F.col("n_rows") >= min_rows)
    found = (
        totals.join(distinct("product_code", "n_products").where(F.col("n_products") >= min_products), d)
        .join(distinct("user_id", "n_users"), d, "left")
        .join(cells.groupBy(*d).agg(ratings), d)
        .withColumn("n_users", F.coalesce("n_users", F.lit(0).cast("long")))
    )
    return reviews.select(F.col(key).alias("_k"), "text").join(found.drop(*d), "_k").drop("_k")


def without_copied_texts(reviews: DataFrame, min_products: int = 3) -> DataFrame:
    """Reviews whose text does not occur under ``min_products`` or more products; joined on digests."""
    tagged = reviews.withColumn("_d", text_digest())
    pairs = tagged.where(F.col("text").isNotNull()).select("_d.hi", "_d.lo", "product_code").distinct()
    copied = pairs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("_p")).where(F.col("_p") >= min_products)
    return tagged.join(copied, (F.col("_d.hi") == copied.hi) & (F.col("_d.lo") == copied.lo), "left_anti").drop("_d")


def matches_keywords(columns: Sequence[str], keywords: Sequence[str]) -> Column:
    pattern = any_of(keywords, "(?iu)")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return out


def exclude_products(
    products: DataFrame, keywords: Sequence[str], columns: Sequence[str] = ("category_1", "category_2", "name")
) -> DataFrame:
    return products.where(~matches_keywords(columns, keywords))


def exclude_reviews_of(reviews: DataFrame, products: DataFrame, keywords: Sequence[str], columns=("category_1", "category_2", "name")) -> DataFrame:
    """Reviews without those of excluded products; a review of an unknown product stays."""
    dropped = products.where(matches_keywords(columns, keywords)).select("product_code")
    return reviews.join(dropped, "product_code", "left_anti")


def in_target_language(
    text: str | Column,
    target: str = TARGET_SCRIPT,
    others: str = OTHER_SCRIPTS,
    words: str = WORD_SCRIPT,
    filler: str | None = FILLER_SCRIPT,
    min_share: float = MIN_SCRIPT_SHARE,
) -> Column:
    """Enough letters of the wanted script, and more than a repeated one or two filler letters."""
    t = F.coalesce(col(text), F.lit(""))
    n_target = F.regexp_count(t, F.lit(target))
    n_all = n_target + F.regexp_count(t, F.lit(others))
    ok = (n_all > 0) & (F.coalesce(ratio(n_target, n_all), F.lit(0.0)) >= min_share)
    if filler is not None:
        letters = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(f"({filler})"), F.lit(1))))
        ok = ok & (t.rlike(words) | (letters == 0) | (letters > 2))
    return ok


def digits(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"[^0-9]", "")


def parse_price(text: str | Column) -> Column:
    return digits(text).try_cast("long")


def parse_rating(text: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(text), r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")


def parse_count(text: str | Column) -> Column:
    """Like a price, but 0 when there is no number."""
    return F.coalesce(digits(text).try_cast("long"), F.lit(0).cast("long"))


def brand_or_fallback(
    brand: str | Column, category: str | Column, name: str | Column, tools: Sequence[str] = TOOL_CATEGORIES, tool_brand: str = TOOL_BRAND
) -> Column:
    """Brand field; else the house brand for tools; else the first word of the name."""
    given = F.nullif(F.trim(col(brand)), F.lit(""))
    first_word = F.split(F.trim(col(name)), r"\s+")[0]
    return F.coalesce(given, F.when(col(category).isin(*tools), F.lit(tool_brand)), first_word, F.lit(""))


def category_suffix(middles: Column, smalls: Column) -> Column:
    """File-name part from two name lists: distinct in order, joined, unsafe characters replaced."""
    joined = F.concat_ws("_", F.array_distinct(middles), F.array_distinct(smalls))
    return F.when(F.size(middles) > 0, F.translate(joined, "/: ", "__")).otherwise(F.lit("all"))


PAGE_FIELDS = {
    # Where the fields of a saved product page stand.
    "url_code": r"pdNo=([A-Z0-9]+)",
    "page_code": r"품번\s*(\d+)",
    "name": r"<h1[^>]*>\s*(.*?)\s*</h1>",
    "price": r"class=\"value\"[^>]*>\s*([\d,]+)",
    "country": r"<th[^>]*>[^<]*제조국[^<]*</th>\s*<td[^>]*>\s*(.*?)\s*</td>",
    "counts": r"class=\"btn__count\"[^>]*>\s*([^<]*)<",
}


def product_page_fields(pages: DataFrame, fields: dict[str, str] = PAGE_FIELDS) -> DataFrame:
    """Structured fields of saved product pages; the number on the page wins over the one in the URL."""

    def grab(source: str, field: str) -> Column:
        return F.nullif(F.regexp_extract(source, "(?s)" + fields[field], 1), F.lit(""))

    counts = F.regexp_extract_all("html", F.lit("(?s)" + fields["counts"]), F.lit(1))
    enough = F.size(counts) >= 2
    return pages.select(
        "*",
        F.coalesce(grab("html", "page_code"), grab("url", "url_code")).alias("product_code"),
        grab("html", "name").alias("name"),
        parse_price(grab("html", "price")).alias("price"),
        grab("html", "country").alias("country"),
        F.when(enough, parse_count(F.get(counts, F.lit(0)))).alias("likes"),
        F.when(enough, parse_count(F.get(counts, F.lit(1)))).alias("shares"),
    )
