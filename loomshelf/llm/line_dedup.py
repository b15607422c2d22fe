"""Line dedup: equal lines and lines within one edited word, by a join over deletion neighbourhoods.

A line is its sequence of words. Two lines of at least ``LEAST_WORDS`` words are near when one word inserted,
deleted or replaced makes them equal (with five words or more, a similarity of 0.8 or more); shorter lines must
be equal. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.llm.common import forget, settle, whole_text

LEAST_WORDS = 5
BLANKS = r"[\x20\x09-\x0D]+"


def _order(row: str = "") -> Column:
    """Where a line stands: by document id (NULL last), text of the document, number of the line."""
    return F.struct(F.col(row + "doc_id").isNull().alias("no_id"), F.col(row + "doc_id").alias("doc_id"), F.col(row + "text_hash").alias("text_hash"), F.col(row + "line_no").alias("line_no"))


def _halves(least: int) -> Column:
    """Hashes of both halves, as a line of its own length and as the longer one of a pair.

    One edit leaves either the words before the middle of the shorter line or those after it as they are, so
    lines that share no such half with another line have no neighbour.
    """

    def pair(m: Column) -> Column:
        h = F.floor(m / 2).cast("int")
        return F.when(
            m >= least,
            F.array(
                F.xxhash64(F.lit(1), m, F.slice("words", F.lit(1), h)),
                F.xxhash64(F.lit(2), m, F.slice("words", F.col("n") - (m - h) + 1, m - h)),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    return F.concat(pair(F.col("n")), pair(F.col("n") - 1))


def _exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(docs, text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))
    lines = rows.select("doc_id", "text_hash", F.posexplode("lines").alias("line_no", "line"))
    words = lines.select("doc_id", "text_hash", "line_no", F.filter(F.split("line", BLANKS), lambda w: w != "").alias("words"))
    return words.withColumn("n", F.size("words")).where("n > 0")


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, hot_share: float = 0.001) -> DataFrame:
    """Which lines go, one row per line with a word: the earliest of equal or near lines stays.

    Columns: ``doc_id``, ``text_hash``, ``line_no`` (from 0), ``n_words``, ``kept``, ``keep_doc_id``,
    ``keep_line_no``. A line is dropped if an earlier line is equal to it or near it; its keep columns name the
    earliest such line. Earlier means a smaller id, then a smaller line number. A dropped line still makes
    later lines near it go, so a chain of small edits collapses onto its beginning.

    Equal lines are counted first, so all later steps run over different lines. Lines that share no half with
    another are left out; of the others each variant with one word deleted, where the shared halves leave room
    for an edit, is emitted as a hashed key. Lines
    with the same variant at the same place differ in that word alone; a variant equal to a whole line has one
    word more. In either case each line is joined to the earliest of its key only, never to all, and the pair
    is verified word by word. A line that makes up more than ``hot_share`` of all lines is broadcast with its verdict.

    NULL and empty texts have no lines; lines without a word are not judged and stay. Rows that repeat an id
    and its text are one document and share the verdict; NULL ids come last. An empty table gives an empty
    table. Other columns are not looked at.
    """
    lines = settle(
        _exploded(docs, id_col, text_col).select("doc_id", "text_hash", "line_no", "n", F.unhex(F.md5(F.concat_ws(" ", "words"))).alias("key"), _halves(least_words).alias("halves")),
        "lines",
    )
    different = settle(
        lines.groupBy("key").agg(F.min(_order()).alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("copies")), "different-lines"
    )
    # lines that share a half with another line
    halves = different.select("key", "n", F.posexplode("halves").alias("k", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    # where the edit can be: not before the middle if the words before it are shared, before it if those after are
    middle = F.floor((F.col("n") - F.when(F.col("k") >= 2, 1).otherwise(0)) / 2).cast("int")
    places = halves.join(shared, "half").groupBy("key").agg(F.min(F.when(F.col("k") % 2 == 0, middle)).alias("late"), F.max(F.when(F.col("k") % 2 == 1, middle)).alias("early"))
    near = places.join(different.select("key", "first", "n"), "key")
    # their words, fetched from the document of each line's first place
    wanted = near.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")).agg(
        F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "key", "late", "early")).alias("wanted")
    )
    text = whole_text(docs, text_col)
    own = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))
    fetched = own.join(wanted, own.doc_id.eqNullSafe(wanted._id) & (own.text_hash == wanted._hash)).select(
        "doc_id", "text_hash", F.explode("wanted").alias("w"), "lines"
    )
    spelled = settle(
        fetched.select("doc_id", "text_hash", "w.*", F.filter(F.split(F.element_at("lines", F.col("w.line_no") + 1), BLANKS), lambda w: w != "").alias("words"))
        .dropDuplicates(["key"])
        .withColumn("n", F.size("words")),
        "near-lines",
    )
    # variants: the hash of a sequence is the xor of the hashes of its words with their places, so running
    # values give each deletion in constant time
    word = spelled.select("key", "n", "late", "early", _order().alias("first"), F.posexplode("words").alias("i", "w")).select(
        "key", "n", "late", "early", "first", "i", F.xxhash64("w", "i").alias("f"), F.xxhash64("w", F.col("i") - 1).alias("g")
    )
    place = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    variants = word.select(
        "key", "n", "late", "early", "first", "i",
        F.bit_xor("f").over(place).bitwiseXOR(F.col("f")).bitwiseXOR(F.bit_xor("g").over(place)).bitwiseXOR(F.bit_xor("g").over(whole)).alias("v"),
        F.bit_xor("f").over(whole).alias("all"),
    )
    # the first place stays for the hash of the whole line
    variants = settle(variants.where((F.col("i") >= F.col("late")) | (F.col("i") < F.col("early")) | (F.col("i") == 0)).drop("late", "early"), "variants")
    # one word replaced: the same variant at the same place
    at = ["n", "i", "v"]
    groups = variants.groupBy(*at).agg(F.min("first").alias("to"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    replaced = variants.join(groups, at).where(F.col("to") < F.col("first")).select("key", "to", "i", F.lit(0).alias("kind"))
    # one word more or less: a variant that is a whole line
    short = variants.where("i = 0").select(F.col("n").alias("_n"), F.col("all").alias("_v"), F.col("key").alias("_key"), F.col("first").alias("_first"))
    pairs = variants.where(F.col("n") > least_words).join(short, (F.col("n") - 1 == F.col("_n")) & (F.col("v") == F.col("_v")))
    longer = pairs.where(F.col("_first") < F.col("first")).select("key", F.col("_first").alias("to"), "i", F.lit(1).alias("kind"))
    shorter = pairs.where(F.col("first") < F.col("_first")).select(F.col("_key").alias("key"), F.col("first").alias("to"), "i", F.lit(-1).alias("kind"))
    best = replaced.unionByName(longer).unionByName(shorter).groupBy("key").agg(F.min(F.struct("to", "i", "kind")).alias("e")).select("key", "e.*")
    # verify: the words around the place are the same
    a = spelled.select("key", F.col("words").alias("a"))
    b = spelled.select(_order().alias("to"), F.col("words").alias("b"))

    def without(words: str) -> Column:
        return F.concat(F.slice(words, F.lit(1), F.col("i")), F.slice(words, F.col("i") + 2, F.greatest(F.size(words) - F.col("i") - 1, F.lit(0))))

    verified = (
        best.join(a, "key")
        .join(b, "to")
        .where(
            F.when(F.col("kind") == 0, without("a") == without("b"))
            .when(F.col("kind") == 1, without("a") == F.col("b"))
            .otherwise(F.col("a") == without("b"))
        )
        .select("key", "to")
    )
    keep = different.select("key", "first", "copies").join(verified, "key", "left").select("key", F.coalesce("to", "first").alias("keep"), "copies")
    keep = settle(keep, "kept-lines")
    for done in (different, spelled, variants):
        forget(done)
    # rows of a very common line get their verdict where they are read, the others by a shuffle
    total = keep.agg(F.sum("copies")).first()[0] or 0  # one number
    is_hot = F.col("copies") > total * hot_share
    hot = F.broadcast(keep.where(is_hot).select("key", "keep"))  # 1 / hot_share rows at most
    rest = lines.join(hot.select("key"), "key", "left_anti").join(keep.where(~is_hot).select("key", "keep"), "key")
    return lines.join(hot, "key").unionByName(rest).select(
        "doc_id",
        "text_hash",
        "line_no",
        F.col("n").alias("n_words"),
        (_order() == F.col("keep")).alias("kept"),
        F.col("keep.doc_id").alias("keep_doc_id"),
        F.col("keep.line_no").alias("keep_line_no"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without the lines that ``line_verdicts`` drops; same columns, order of lines kept.

    Documents that lose every word go; documents that had none stay. NULL texts and long ones, repeated rows and NULL
    ids are handled as by ``line_verdicts``; an empty table stays empty.
    """
    verdicts = line_verdicts(docs, id_col, text_col, least_words)
    gone = (
        verdicts.where(~F.col("kept"))
        .groupBy(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash"))
        .agg(F.collect_set("line_no").alias("_llm_gone"))
    )
    text = whole_text(docs, text_col)
    own = docs.withColumn("_llm_own", F.xxhash64(text))
    joined = own.join(gone.hint("merge"), own[id_col].eqNullSafe(gone._llm_id) & (own._llm_own == gone._llm_hash), "left")
    lines = joined.withColumn("_llm_lines", F.when(F.col("_llm_gone").isNotNull(), F.split(joined[text_col].cast("string"), "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_llm_lines") - 1), "_llm_gone")
    rest = lines.withColumn("_llm_rest", F.when(F.col("_llm_gone").isNotNull(), F.array_join(F.transform(left, lambda i: F.col("_llm_lines")[i]), "\n")))
    kept = rest.where(F.col("_llm_rest").isNull() | F.col("_llm_rest").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn(text_col, F.coalesce(F.col("_llm_rest"), kept[text_col])).select(*docs.columns)
