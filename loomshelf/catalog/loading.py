"""Source/sink (IO*) and dimension-loading (DIM*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshelf.catalog.registry import query, rounded
from loomshelf.catalog.reviews import KEY, KEYS
from loomshelf.operators import dimensions as dim
from loomshelf.sources import files, tables, versioned
from loomshelf.sources import views as v
from loomshelf.sources.views import with_views


@query(
    "io1_category_from_file",
    """SELECT doc_id, source || ' ' || lang AS category FROM documents""",
)
def io1(spark, sf):
    """One CSV file, or folder of parts, for each category, read back by a pattern."""
    drop = tables.new_path(spark, "drop")
    file = F.concat(F.lit("product_"), "source", F.lit(" "), "lang", F.lit(".csv"))
    docs = v.table(spark, sf, "documents").select("doc_id", F.col("text").alias("name"), file.alias("file"))
    docs.write.partitionBy("file").option("header", True).option("escape", '"').csv(drop)
    return files.read_category_csv(spark, f"{drop}/file=*", "doc_id bigint, name string").select("doc_id", "category")


PARTS = {
    "a": "SELECT product_code, name, brand, likes FROM products WHERE price <= 3000",
    "b": "SELECT product_code, name || ' (new)' AS name, brand FROM products WHERE price >= 2000",
}


def parts(spark, sf):
    p = v.products(spark, sf)
    a = p.where("price <= 3000").select("product_code", "name", "brand", "likes")
    b = p.where("price >= 2000").select("product_code", F.concat("name", F.lit(" (new)")).alias("name"), "brand")
    return a, b


@query(
    "io2_union_parts",
    with_views(
        """SELECT product_code, name, brand, likes FROM a UNION ALL
        SELECT product_code, name, brand, NULL FROM b WHERE product_code NOT IN (SELECT product_code FROM a)""",
        "products",
        **PARTS,
    ),
)
def io2(spark, sf):
    a, b = parts(spark, sf)
    tagged = [a.withColumn("_part", F.lit(0)), b.withColumn("_part", F.lit(1))]
    return files.union_parts(tagged, ["product_code"], ["_part"]).drop("_part")


@query(
    "io3_append_rows",
    with_views("SELECT product_code, name, brand FROM a UNION ALL SELECT product_code, name, brand FROM b", "products", **PARTS),
)
def io3(spark, sf):
    a, b = parts(spark, sf)
    path = tables.new_path(spark, "append")
    tables.insert(a.select("product_code", "name", "brand"), path, "replace")
    tables.insert(b, path, "append")
    return spark.read.parquet(path)


@query(
    "io4_upsert",
    with_views(
        """SELECT coalesce(a.product_code, b.product_code) AS product_code, CASE WHEN b.product_code IS NOT NULL THEN b.name ELSE a.name END AS name,
        CASE WHEN b.product_code IS NOT NULL THEN b.brand ELSE a.brand END AS brand, a.likes
        FROM a FULL JOIN b ON a.product_code = b.product_code""",
        "products",
        **PARTS,
    ),
)
def io4(spark, sf):
    a, b = parts(spark, sf)
    return dim.upsert(a, b, ["product_code"])


def versioned_table(spark, sf):
    """The first part of the products as a table of 32 buckets."""
    a, b = parts(spark, sf)
    path = tables.new_path(spark, "versioned")
    versioned.create(a, path, ["product_code"], 32)
    return path, b


@query(
    "io4_upsert_buckets",
    with_views(
        """SELECT coalesce(a.product_code, b.product_code) AS product_code, CASE WHEN b.product_code IS NOT NULL THEN b.name ELSE a.name END AS name,
        CASE WHEN b.product_code IS NOT NULL THEN b.brand ELSE a.brand END AS brand, a.likes
        FROM a FULL JOIN b ON a.product_code = b.product_code""",
        "products",
        **PARTS,
    ),
)
def io4v(spark, sf):
    """In two changes, each of which rewrites the buckets of its keys only."""
    path, b = versioned_table(spark, sf)
    versioned.upsert(b.where("product_code % 2 = 0"), path)
    versioned.upsert(b.where("product_code % 2 <> 0"), path)
    return versioned.read(spark, path)


DELETED = with_views("SELECT * FROM a WHERE product_code NOT IN (SELECT product_code FROM b)", "products", **PARTS)


def deleted(spark, sf):
    path, b = versioned_table(spark, sf)
    versioned.delete(b.where("product_code % 3 = 0"), path)
    versioned.delete(b.where("product_code % 3 <> 0"), path)
    return path


@query("io5_delete_marks", DELETED)
def io5v(spark, sf):
    """Two deletes as bitmaps of row positions, left out when the table is read."""
    return versioned.read(spark, deleted(spark, sf))


@query("io5_delete_compacted", DELETED)
def io5w(spark, sf):
    path = deleted(spark, sf)
    versioned.compact(spark, path)
    return versioned.read(spark, path)


@query("io5_delete_by_key", with_views("SELECT * FROM a WHERE product_code NOT IN (SELECT product_code FROM b)", "products", **PARTS))
def io5(spark, sf):
    a, b = parts(spark, sf)
    return dim.delete_by_key(a, b, ["product_code"])


@query("io6_row_count", "SELECT count(*) AS n_rows FROM lineitem")
def io6(spark, sf):
    return tables.row_count(v.table(spark, sf, "lineitem"))


@query("io6_preview", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def io6c(spark, sf):
    return tables.preview(v.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


def label_frame(spark, sf):
    d = v.doc_reviews(spark, sf)
    sentiment = F.when(F.col("rating") >= 4, "positive").when(F.col("rating") <= 2, "negative").otherwise("neutral")
    aspect = F.struct(F.col("lang").alias("aspect"), sentiment.alias("sentiment"), F.lit(0.75).alias("confidence"), F.col("source").alias("reason"))
    return d.select(
        F.col("order_id").alias("index"),
        "text",
        "rating",
        sentiment.alias("sentiment"),
        ((F.col("rating") - 3) / 2).alias("sentiment_score"),
        F.array(aspect).alias("aspect_labels"),
        F.col("source").alias("model"),
    )


SENTIMENT = "CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END"


@query(
    "io7_read_labels",
    with_views(
        f"""SELECT order_id AS "index", text, rating, {SENTIMENT} AS sentiment, (rating - 3) / 2 AS sentiment_score, lang AS aspect, source AS reason
        FROM doc_reviews""",
        "doc_reviews",
    ),
)
def io7(spark, sf):
    path = tables.new_path(spark, "labels")
    frame = label_frame(spark, sf)
    lines = frame.select(F.to_json(F.struct(*frame.columns)).alias("value"))
    broken = frame.select(F.concat(F.lit("{broken "), F.col("index").cast("string")).alias("value"))
    lines.unionByName(broken).write.text(path)
    a = F.get("aspect_labels", F.lit(0))
    return files.read_labels(spark, path).select(
        "index", "text", "rating", "sentiment", "sentiment_score", a["aspect"].alias("aspect"), a["reason"].alias("reason")
    )


@query(
    "io8_parse_responses",
    with_views(
        f"""SELECT order_id AS idx, CASE WHEN rating > 2 THEN {SENTIMENT} END AS sentiment, CASE WHEN rating > 2 THEN lang END AS aspect,
        rating > 2 AS success, CASE WHEN rating = 1 THEN 'rate limit' WHEN rating = 2 THEN 'content is not valid JSON' END AS error FROM doc_reviews""",
        "doc_reviews",
    ),
)
def io8(spark, sf):
    frame = label_frame(spark, sf)
    good = F.to_json(F.struct("sentiment", "sentiment_score", "aspect_labels"))
    content = F.when(F.col("rating") == 2, F.lit("sorry, no")).otherwise(F.concat(F.lit("Here you are: "), good, F.lit("\nbye")))
    fine = F.col("rating") != 1
    choices = F.array(F.struct(F.struct(content.alias("content")).alias("message")))
    response = F.struct(
        F.when(fine, 200).otherwise(429).alias("status_code"), F.when(fine, F.struct(choices.alias("choices"))).alias("body")
    )
    error = F.when(~fine, F.struct(F.lit("rate limit").alias("message")))
    lines = frame.select(
        F.to_json(
            F.struct(F.concat(F.lit("review-"), F.col("index").cast("string")).alias("custom_id"), response.alias("response"), error.alias("error"))
        ).alias("value")
    )
    d = files.parse_responses(lines)
    return d.select("idx", "sentiment", F.get("aspect_labels", F.lit(0))["aspect"].alias("aspect"), "success", "error")


@query(
    "io9_training_export",
    with_views("SELECT order_id, product_code, text, rating FROM doc_reviews WHERE length(text) >= 40", "doc_reviews"),
)
def io9(spark, sf):
    path = tables.new_path(spark, "training")
    tables.export_training(v.doc_reviews(spark, sf), path, 40)
    schema = "order_id bigint, product_code bigint, text string, rating double"
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query(
    "io10_bullet_lines",
    r"""WITH l AS (SELECT source || '/' || doc_id AS file, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
    SELECT file, doc_id AS product_id, CAST(pos AS BIGINT) AS row, trim(line) AS ingredient FROM l WHERE trim(line) <> ''""",
)
def io10(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", "source", "text")
    bullets = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("• "), x))
    lines = d.select(
        F.concat_ws("/", "source", "doc_id").alias("file"),
        F.lit(0).alias("block"),
        F.posexplode(F.concat(F.array(F.col("doc_id").cast("string")), bullets)).alias("row", "value"),
    )
    found = files.parse_bullets(lines.withColumn("row", F.col("row").cast("long")))
    return found.select("file", "product_id", "row", "ingredient")


@query(
    "io11_ambiguous_output",
    with_views("SELECT order_id, rating FROM doc_reviews WHERE rating = 3", "doc_reviews"),
)
def io11(spark, sf):
    results = v.doc_reviews(spark, sf).select("order_id", "rating", (F.col("rating") == 3).alias("is_ambiguous"))
    path, second = tables.new_path(spark, "results"), tables.new_path(spark, "ambiguous")
    tables.write_with_ambiguous(results, "is_ambiguous", path, second)
    return spark.read.parquet(second).select("order_id", "rating")


BRAND_DIM = "SELECT c_custkey AS brand_id, 'Brand#' || CAST(c_custkey + 1 AS VARCHAR) AS brand_name FROM customer WHERE c_mktsegment = 'BUILDING'"


@query(
    "dim1_lookup_id",
    with_views("SELECT product_code, brand, brand_id FROM products LEFT JOIN d ON brand = brand_name", "products", d=BRAND_DIM),
)
def dim1(spark, sf):
    d = v.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("brand_id"), F.concat(F.lit("Brand#"), (F.col("c_custkey") + 1).cast("string")).alias("brand_name")
    )
    return dim.lookup_id(v.products(spark, sf).select("product_code", "brand"), d, "brand", "brand_name", "brand_id")


SEEN_ORDER = ["date", "order_key", "line_no"]
KNOWN = "SELECT c_custkey AS user_id, 'user-' || CAST(c_custkey AS VARCHAR) AS user_masked, c_mktsegment AS activity_level FROM customer WHERE c_mktsegment = 'BUILDING'"
INCOMING = "SELECT *, 'user-' || CAST(user_id AS VARCHAR) AS user_masked FROM reviews"
ADDED = """SELECT (SELECT max(user_id) FROM known) + row_number() OVER (ORDER BY f, user_masked) AS user_id, user_masked, CAST(NULL AS VARCHAR) AS activity_level
FROM (SELECT user_masked, min((date, order_key, line_no)) AS f FROM incoming WHERE user_masked NOT IN (SELECT user_masked FROM known) GROUP BY 1)"""


def known_users(spark, sf):
    return v.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_masked"),
        F.col("c_mktsegment").alias("activity_level"),
    )


def masked_reviews(spark, sf):
    d = v.reviews(spark, sf)
    return d.withColumn("user_masked", F.concat(F.lit("user-"), F.col("user_id").cast("string")))


@query("dim2_register_users", with_views("SELECT * FROM known UNION ALL SELECT * FROM added", "reviews", known=KNOWN, incoming=INCOMING, added=ADDED))
def dim2(spark, sf):
    return dim.register_members(
        known_users(spark, sf), masked_reviews(spark, sf), "user_masked", "user_masked", "user_id", SEEN_ORDER, [F.col("date")]
    )


ORDERED = f"row_number() OVER (ORDER BY date, {KEYS})"


@query("dim3_order_ids", with_views(f"SELECT {KEYS}, date, (SELECT max(o_orderkey) FROM orders) + {ORDERED} AS order_id FROM reviews", "reviews"))
def dim3(spark, sf):
    d = v.reviews(spark, sf).select("date", *KEY)
    last = v.table(spark, sf, "orders").agg(F.max("o_orderkey"))
    # days first, then blocks of orders inside the day: both rise along the order
    return dim.assign_ids(d, last, ["date", *KEY], [F.col("date"), F.expr("order_key div 1000000")])


@query(
    "dim4_user_keys",
    with_views(
        """SELECT user_masked, printf('user_%04d', row_number() OVER (ORDER BY f, user_masked)) AS "user"
        FROM (SELECT user_masked, min((date, order_key, line_no)) AS f FROM incoming GROUP BY 1)""",
        "reviews",
        incoming=INCOMING,
    ),
)
def dim4(spark, sf):
    return dim.user_keys(masked_reviews(spark, sf), SEEN_ORDER, [F.col("date")])


TARGETS = {
    "t": "SELECT product_code, name, 1 AS brand_id FROM products WHERE price <= 3000",
    "m": "SELECT product_code, likes, 0 AS review_count FROM products WHERE price <= 3000",
    "c": "SELECT product_code, upper(name) AS name, likes + 1 AS likes FROM products WHERE price >= 2000",
}


@query(
    "dim5_load_products",
    with_views(
        """SELECT coalesce(t.product_code, c.product_code) AS product_code, coalesce(c.name, t.name) AS name, t.brand_id,
        coalesce(c.likes, m.likes) AS likes, m.review_count
        FROM t FULL JOIN c ON t.product_code = c.product_code LEFT JOIN m ON m.product_code = t.product_code""",
        "products",
        **TARGETS,
    ),
)
def dim5(spark, sf):
    p = v.products(spark, sf)
    old = p.where("price <= 3000")
    targets = {
        "products": old.select("product_code", "name", F.lit(1).alias("brand_id")),
        "product_metrics": old.select("product_code", "likes", F.lit(0).alias("review_count")),
    }
    crawl = p.where("price >= 2000").select("product_code", F.upper("name").alias("name"), (F.col("likes") + 1).alias("likes"))
    out = dim.load_products(targets, crawl, ["likes"])
    return out["products"].join(out["product_metrics"], "product_code")


DOC_CRAWL = "SELECT *, source || '*' AS user_masked FROM doc_reviews"
LOADED = {
    "crawl": DOC_CRAWL,
    "known": "SELECT 7 AS user_id, 'src3*' AS user_masked",
    "users": """SELECT * FROM known UNION ALL SELECT 7 + row_number() OVER (ORDER BY f), user_masked
    FROM (SELECT user_masked, min(order_id) AS f FROM crawl WHERE user_masked <> 'src3*' GROUP BY 1)""",
    "fresh": """SELECT 500 + row_number() OVER (ORDER BY first_row) AS order_id, product_code, user_id, date AS write_date, rating, length(text) AS n
    FROM (SELECT c.product_code, u.user_id, date, text, min(order_id) AS first_row, arg_min(rating, order_id) AS rating
          FROM crawl c JOIN users u USING (user_masked) GROUP BY ALL)""",
}


@query(
    "dim6_load_reviews",
    with_views(
        """SELECT order_id, product_code, user_id, write_date, rating, false AS is_reorder, CAST(n AS INTEGER) AS length,
        CASE WHEN n <= 0 THEN NULL WHEN n <= 20 THEN 'very_short' WHEN n <= 50 THEN 'short' WHEN n <= 100 THEN 'medium' WHEN n <= 500 THEN 'long' ELSE 'very_long' END AS length_category
        FROM fresh""",
        "doc_reviews",
        **LOADED,
    ),
)
def dim6(spark, sf):
    crawl = v.doc_reviews(spark, sf).select(
        F.col("order_id").alias("row_no"), F.concat("source", F.lit("*")).alias("user_masked"), "product_code", "date", "text", "rating", F.lit(0).alias("image_count")
    )
    users = crawl.agg(F.lit(7).alias("user_id"), F.lit("src3*").alias("user_masked"))
    reviews = crawl.agg(F.lit(500).cast("long").alias("order_id"))
    analysis = reviews.select("order_id", F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("length_category"))
    out = dim.load_reviews(reviews, analysis, users, crawl, ["row_no"], [F.expr("row_no div 268435456"), F.expr("row_no div 4096")], stage=tables.settle)
    return out["reviews"].join(out["review_analysis"], "order_id").drop("text", "image_count")


WORDS = """SELECT doc_id AS product_id, CAST(pos AS BIGINT) AS pos, lower(word) AS ingredient FROM (
SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) WHERE word <> ''"""
MASTER = "SELECT dense_rank() OVER (ORDER BY ingredient) AS ingredient_id, ingredient AS name FROM (SELECT DISTINCT ingredient FROM words WHERE length(ingredient) >= 4)"


def word_rows(spark, sf, dealt=False):
    texts = v.table(spark, sf, "documents").select(F.col("doc_id").alias("product_id"), "text")
    texts = texts.repartition("product_id") if dealt else texts
    d = texts.select("product_id", F.posexplode_outer(F.split("text", " ")).alias("pos", "word"))
    return d.where("word <> ''").select("product_id", F.col("pos").cast("long").alias("pos"), F.lower("word").alias("ingredient"))


@query(
    "dim7_product_ingredients",
    with_views(
        """SELECT product_id, name AS ingredient, min(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY pos) AS rank FROM words)
        JOIN master ON name = ingredient GROUP BY 1, 2""",
        words=WORDS,
        master=MASTER,
    ),
)
def dim7(spark, sf):
    names = word_rows(spark, sf).where(F.length("ingredient") >= 4).select(F.col("ingredient").alias("name")).distinct()
    master = names.withColumn("ingredient_id", F.col("name"))
    # a text is dealt out whole, by the product, so that its words are ranked where they are cut
    rows = word_rows(spark, sf, dealt=True)
    d = dim.product_ingredients(rows, master, "product_id", "ingredient", ["pos"], [F.expr("pos div 4096")])
    return d.select("product_id", F.col("ingredient_id").alias("ingredient"), "rank")


@query(
    "dim7_overlay_verdicts",
    with_views(
        """SELECT p.product_code, coalesce(h, 'Unknown') AS can_halal, coalesce(g, 'Unknown') AS can_vegan FROM products p LEFT JOIN (
        SELECT product_code, arg_min(h, (order_key, line_no, supplier_key, quantity)) FILTER (h IS NOT NULL) AS h,
        arg_min(g, (order_key, line_no, supplier_key, quantity)) FILTER (g IS NOT NULL) AS g FROM (SELECT *,
        CASE WHEN rating = 1 THEN 'No' WHEN rating = 5 THEN 'Yes' END AS h, CASE WHEN rating = 2 THEN 'No' WHEN rating = 4 THEN 'Yes' END AS g FROM reviews)
        GROUP BY 1) v ON v.product_code = p.product_code""",
        "products",
        "reviews",
    ),
)
def dim7b(spark, sf):
    rows = v.reviews(spark, sf).select(
        "product_code",
        "order_key",
        "line_no",
        "supplier_key",
        "quantity",
        F.when(F.col("rating") == 1, "No").when(F.col("rating") == 5, "Yes").alias("can_halal"),
        F.when(F.col("rating") == 2, "No").when(F.col("rating") == 4, "Yes").alias("can_vegan"),
    )
    attributes = v.products(spark, sf).select("product_code", F.lit("Unknown").alias("can_halal"), F.lit("Unknown").alias("can_vegan"))
    return dim.overlay_verdicts(attributes, rows, ["order_key", "line_no", "supplier_key", "quantity"])


@query(
    "dim8_distribute_columns",
    with_views(
        """, p AS (SELECT product_code, arg_min(source, order_id) AS functional FROM doc_reviews GROUP BY 1),
        x AS (SELECT products.product_code, functional FROM products LEFT JOIN p USING (product_code)),
        y AS (SELECT d.order_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'fine' END END AS event_type
              FROM doc_reviews d LEFT JOIN labels l ON l.doc_id = d.order_id)
        SELECT 'functional' AS column_name, count(functional) AS n_matched, round(100.0::DOUBLE * (count(*) - count(functional)) / count(*), 8) AS null_pct FROM x
        UNION ALL SELECT 'event_type', count(event_type), round(100.0::DOUBLE * (count(*) - count(event_type)) / count(*), 8) FROM y""",
        "products",
        "doc_reviews",
    ),
)
def dim8(spark, sf):
    docs = v.doc_reviews(spark, sf)
    marks = v.table(spark, sf, "labels").select(
        F.col("doc_id").alias("_doc"), F.when(F.col("toxic") == 1, "toxic").otherwise("fine").alias("event_type")
    )
    wide = docs.join(marks, F.col("order_id") == F.col("_doc"), "left").select(
        "product_code",
        F.col("source").alias("functional"),
        F.when(F.col("_doc").isNotNull(), F.col("order_id").cast("double")).alias("order_id"),
        "event_type",
        F.col("order_id").alias("row_no"),
    )
    out = dim.distribute_columns(
        v.products(spark, sf).select("product_code"), docs.select("order_id"), wide, ["functional"], ["event_type"], ["row_no"]
    )
    p = dim.match_report(out["products"], ["functional"])
    return rounded(p.unionByName(dim.match_report(out["reviews"], ["event_type"])), "null_pct")


@query(
    "dim9_missing_ingredients",
    with_views(
        """, e AS (SELECT product_id, 'doc' AS name, ingredient FROM words WHERE product_id IN (SELECT doc_id FROM labels)),
        x AS (SELECT w.product_id, coalesce(p.name, '(product ' || CAST(w.product_id AS VARCHAR) || ')') AS name, ingredient FROM words w
              LEFT JOIN products p ON p.product_code = w.product_id AND p.price > 2000 WHERE w.product_id NOT IN (SELECT product_id FROM e))
        SELECT DISTINCT * FROM (SELECT * FROM e UNION ALL SELECT * FROM x)""",
        "products",
        words=WORDS,
    ),
)
def dim9(spark, sf):
    rows = word_rows(spark, sf)
    covered = v.table(spark, sf, "labels").select(F.col("doc_id").alias("product_id"))
    existing = rows.join(covered, "product_id", "left_semi").select("product_id", F.lit("doc").alias("name"), "ingredient", "pos")
    named = v.products(spark, sf).where("price > 2000").select("product_code", "name")
    d = dim.add_missing_ingredients(existing, rows.select("product_id", "ingredient", "pos"), named, ["pos"])
    return d.select("product_id", "name", "ingredient")


ANALYSIS = "SELECT doc_id AS order_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END END AS sentiment FROM labels"


def analysis(spark, sf):
    s = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "negative").otherwise("positive"))
    return v.table(spark, sf, "labels").select(F.col("doc_id").alias("order_id"), s.alias("sentiment"))


@query(
    "dim10_unanalysed",
    with_views(
        """SELECT r.order_id, r.product_code FROM doc_reviews r LEFT JOIN a USING (order_id) WHERE sentiment IS NULL AND length(text) >= 100""",
        "doc_reviews",
        a=ANALYSIS,
    ),
)
def dim10(spark, sf):
    return dim.unanalysed(v.doc_reviews(spark, sf), analysis(spark, sf), 100).select("order_id", "product_code")


@query(
    "dim11_write_back",
    with_views(
        """SELECT coalesce(a.order_id, r.order_id) AS order_id, CASE WHEN r.order_id IS NOT NULL THEN 'neutral' ELSE a.sentiment END AS sentiment,
        CASE WHEN r.order_id IS NOT NULL THEN 0.0::DOUBLE END AS sentiment_score, a.length
        FROM (SELECT *, 1 AS length FROM a) a FULL JOIN (SELECT order_id FROM doc_reviews WHERE rating = 3) r ON a.order_id = r.order_id""",
        "doc_reviews",
        a=ANALYSIS,
    ),
)
def dim11(spark, sf):
    target = analysis(spark, sf).select("order_id", "sentiment", F.lit(None).cast("double").alias("sentiment_score"), F.lit(1).alias("length"))
    labels = v.doc_reviews(spark, sf).where("rating = 3").select("order_id", F.lit("neutral").alias("sentiment"), F.lit(0.0).alias("sentiment_score"))
    return dim.write_back(target, labels)


@query(
    "dim12_progress",
    with_views(
        """SELECT *, round(100.0::DOUBLE * n_positive / analysed, 8) AS pct_positive, round(100.0::DOUBLE * n_neutral / analysed, 8) AS pct_neutral,
        round(100.0::DOUBLE * n_negative / analysed, 8) AS pct_negative FROM (SELECT count(*) AS total, count(sentiment) AS analysed,
        count(*) - count(sentiment) AS not_analysed, count(*) FILTER (sentiment = 'positive') AS n_positive, count(*) FILTER (sentiment = 'neutral') AS n_neutral,
        count(*) FILTER (sentiment = 'negative') AS n_negative FROM doc_reviews LEFT JOIN a USING (order_id))""",
        "doc_reviews",
        a=ANALYSIS,
    ),
)
def dim12(spark, sf):
    d = dim.progress(v.doc_reviews(spark, sf), analysis(spark, sf))
    return rounded(d, "pct_positive", "pct_neutral", "pct_negative")
