"""Tokens, keyword counts, TF-IDF, co-occurrence and regex category mining."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.functions.columns import any_of, col, ratio, unnest
from loomshelf.functions.lexicon import KEYWORDS, NEGATIVE_SUFFIX, PATTERNS, POSITIVE_SUFFIX, STOP_WORDS, rule_frame
from loomshelf.functions.literals import required_literals
from loomshelf.functions.ranking import top_per_group

Rules = Mapping[str, Sequence[str]]


def tokens(text: str | Column = "text", min_length: int = 2, tagger: Callable[[Column], Column] | None = None) -> Column:
    """Word tokens of at least ``min_length`` characters that are not numbers.

    ``tagger`` swaps in a column function (for instance a pandas UDF around a morphological analyser)
    that turns cleaned text into an array of stems.
    """
    cleaned = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[^\p{L}\p{N}_\s]", " ")
    words = tagger(cleaned) if tagger else F.split(cleaned, r"\s+")
    return F.filter(words, lambda t: (F.length(t) >= min_length) & ~t.rlike(r"^\p{Nd}+$"))


def without_stop_words(words: str | Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Drop stop words, keeping order and repeats."""
    return F.filter(col(words), lambda t: ~t.isin(*stop_words))


def clean_tokens(words: str | Column) -> Column:
    return F.filter(F.transform(col(words), lambda t: F.trim(t)), lambda t: t != "")


def keyword_counts(df: DataFrame, words: str = "tokens") -> DataFrame:
    """Occurrences per keyword. Tokens are counted inside each partition before any row is shuffled."""
    found = df.select(unnest(words, "keyword")).where(F.col("keyword").isNotNull())
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"))


def top_keywords(df: DataFrame, n: int = 50, words: str = "tokens") -> DataFrame:
    return keyword_counts(df, words).orderBy(F.desc("frequency"), "keyword").limit(n)


def compare_groups(df: DataFrame, in_first: Column, n: int = 30, words: str = "tokens") -> DataFrame:
    """Most frequent keywords of two groups side by side, the largest differences kept."""
    first = top_keywords(df.where(in_first), 2 * n, words).withColumnRenamed("frequency", "freq_1")
    second = top_keywords(df.where(~in_first), 2 * n, words).withColumnRenamed("frequency", "freq_2")
    zero = F.lit(0).cast("long")
    merged = (
        first.join(second, "keyword", "full_outer")
        .withColumns({"freq_1": F.coalesce("freq_1", zero), "freq_2": F.coalesce("freq_2", zero)})
        .withColumns({"total_freq": F.col("freq_1") + F.col("freq_2"), "diff": F.col("freq_1") - F.col("freq_2")})
        .withColumn("abs_diff", F.abs("diff"))
    )
    return merged.orderBy(F.desc("abs_diff"), "keyword").limit(n).orderBy(F.desc("diff"), "keyword")


def category_totals(df: DataFrame, rules: Rules = KEYWORDS, words: str = "tokens") -> DataFrame:
    """Tokens that are keywords of a category; 0 for categories nobody mentions.

    The rule table is hand-written, so it is broadcast; it meets counted keywords and not raw tokens.
    """
    table = rule_frame(df.sparkSession, rules).distinct()
    hits = keyword_counts(df, words).join(F.broadcast(table), "keyword").groupBy("category").agg(F.sum("frequency").alias("_f"))
    names = table.select("category").distinct()
    return names.join(hits, "category", "left").select("category", F.coalesce("_f", F.lit(0).cast("long")).alias("frequency"))


def category_counts(words: str | Column = "tokens", rules: Rules = KEYWORDS) -> dict[str, Column]:
    """Per text: tokens that are keywords of each category."""

    def hits(keywords: Sequence[str]) -> Column:
        return F.size(F.filter(col(words), lambda t: t.isin(*keywords)))

    return {category: hits(keywords) for category, keywords in rules.items()}


def tfidf(df: DataFrame, doc: str, text: str, n: int = 20, max_features: int = 1000) -> DataFrame:
    """Mean TF-IDF weight per term over all documents.

    idf = ln((1+n)/(1+df)) + 1, each document scaled to unit length, vocabulary = the most frequent terms.
    """
    docs = df.select(F.col(doc).alias("_d"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    words = docs.select("_d", unnest(F.split("_t", r"[^\p{L}\p{N}_]+"), "keyword")).where(F.col("keyword") != "")
    tf = words.groupBy("_d", "keyword").agg(F.count(F.lit(1)).alias("_tf"))
    vocabulary = (
        tf.groupBy("keyword")
        .agg(F.sum("_tf").alias("_total"), F.count(F.lit(1)).alias("_df"))
        .orderBy(F.desc("_total"), "keyword")
        .limit(max_features)
        .crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("_n"))))
        .select("keyword", "_n", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    )
    weighted = tf.join(F.broadcast(vocabulary), "keyword").withColumn("_w", F.col("_tf") * F.col("_idf"))
    # one entry per vocabulary term at most, so the list is bounded
    per_doc = weighted.groupBy("_d", "_n").agg(
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"), F.collect_list(F.struct("keyword", "_w")).alias("_terms")
    )
    scores = (
        per_doc.select("_n", "_norm", F.explode("_terms").alias("_x"))
        .groupBy(F.col("_x.keyword").alias("keyword"))
        .agg((F.sum(F.col("_x._w") / F.col("_norm")) / F.first("_n")).alias("tfidf_score"))
    )
    return scores.orderBy(F.desc(F.round("tfidf_score", 9)), "keyword").limit(n)


def cooccurrence(df: DataFrame, target: str, n: int = 20, words: str = "tokens") -> DataFrame:
    """Other tokens in texts that contain the target, every occurrence counted."""
    inside = df.where(F.array_contains(words, target)).select(F.filter(words, lambda t: t != target).alias(words))
    return top_keywords(inside, n, words)


def merged_frequency(totals: DataFrame) -> DataFrame:
    """Frequencies with the positive and negative half of a category added up under its plain name."""
    base = F.col("category")
    for suffix in (POSITIVE_SUFFIX, NEGATIVE_SUFFIX):
        base = F.when(base.endswith(suffix), F.expr(f"substring(category, 1, length(category) - {len(suffix)})")).otherwise(base)
    return totals.select(base.alias("category"), "frequency").groupBy("category").agg(F.sum("frequency").alias("frequency"))


def category_ratio(totals: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """frequency(A) / frequency(B) per pair; x/0 is infinite and 0/0 is 0. A split category is merged by its plain name."""
    def of(name: str) -> Column:
        halves = [name, name + POSITIVE_SUFFIX, name + NEGATIVE_SUFFIX]
        exact = F.max(F.when(F.col("category") == name, F.col("frequency")))
        return F.coalesce(exact, F.sum(F.when(F.col("category").isin(*halves), F.col("frequency"))), F.lit(0))

    wide = totals.agg(*[f for i, (a, b) in enumerate(pairs) for f in (of(a).alias(f"_a{i}"), of(b).alias(f"_b{i}"))])
    rows = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"_a{i}"), F.col(f"_b{i}")
        r = F.when(y != 0, x / y).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(f"{a}/{b}").alias("pair"), r.alias("ratio")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mentioning(df: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """Rows that match any pattern, case ignored."""
    return df.where(F.col(text).rlike(any_of(patterns, "(?iuU)")))


def matches(text: str | Column, pattern: str) -> Column:
    """Non-overlapping matches of one pattern; 0 for NULL. A text without any literal that the pattern needs is not searched."""
    found = F.regexp_count(col(text), F.lit("(?U)" + pattern))
    signs = required_literals(pattern)
    if signs is not None:
        holds = _tree([F.contains(col(text), F.lit(s)) for s in sorted(signs)], lambda a, b: a | b)
        found = F.when(holds, found)
    return F.coalesce(found, F.lit(0))


def may_match(rules: Rules = PATTERNS, text: str | Column = "text") -> Column:
    """Whether a text holds a literal that some pattern needs, in one reading; True if a pattern names none."""
    signs = [required_literals(p) for patterns in rules.values() for p in patterns]
    if any(s is None for s in signs):
        return F.lit(True)
    words = sorted(frozenset().union(*signs))
    if not words:
        return F.lit(False)
    # first letters beyond ASCII as one range: a set of hundreds of letters is tried one by one
    first = sorted({w[0] for w in words})
    far = [c for c in first if not c.isascii()]
    opens = "".join(re.escape(c) for c in first if c.isascii()) + (f"{far[0]}-{far[-1]}" if far else "")
    return col(text).rlike(f"(?=[{opens}])(?:" + "|".join(map(re.escape, words)) + ")")


def _tree(parts: Sequence[Column], join: Callable[[Column, Column], Column]) -> Column:
    """Columns joined in pairs, and the pairs again: an expression no deeper than the digits of their number."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


#: Patterns that are added in one compiled expression.
COMPILED = 24


def pattern_counts(rules: Rules = PATTERNS, text: str | Column = "text") -> dict[str, Column]:
    """Per text: matches of each category, summed over its patterns."""
    add = lambda a, b: a + b
    small = sum(map(len, rules.values())) <= COMPILED
    out = {}
    for category, patterns in rules.items():
        found = [F.lit(0), *[matches(text, p) for p in patterns]]
        # hundreds of patterns make more code than can be compiled; an array of them is evaluated in parts
        out[category] = _tree(found, add) if small else F.aggregate(F.array(*found), F.lit(0), add)
    return out


def has_category(category: str, rules: Rules = PATTERNS, text: str | Column = "text") -> Column:
    """Any pattern of the category; one alternation, so the text is read once."""
    return F.coalesce(col(text).rlike(any_of(rules[category], "(?U)")), F.lit(False))


def _unpivot(wide: DataFrame, names: Sequence[str], keys: Sequence[str], label: str, value: str) -> DataFrame:
    rows = [F.struct(F.lit(n).alias(label), F.col(f"_c{i}").alias(value)) for i, n in enumerate(names)]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def category_frequency(df: DataFrame, rules: Rules = PATTERNS, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Matches per category over the corpus, or per group and category."""
    sums = [F.sum(c).cast("long").alias(f"_c{i}") for i, c in enumerate(pattern_counts(rules, text).values())]
    return _unpivot(df.groupBy(*by).agg(*sums), list(rules), by, "category", "frequency")


def pattern_frequency(df: DataFrame, category: str, rules: Rules = PATTERNS, text: str = "text", n: int | None = None) -> DataFrame:
    """Texts matching each pattern of a category, most frequent first."""
    patterns = list(rules[category])
    hits = [F.count_if(F.coalesce(F.col(text).rlike("(?U)" + p), F.lit(False))).alias(f"_c{i}") for i, p in enumerate(patterns)]
    found = _unpivot(df.agg(*hits), patterns, (), "pattern", "n_texts").where("n_texts > 0").orderBy(F.desc("n_texts"), "pattern")
    return found.limit(n) if n is not None else found


def scarcity(df: DataFrame, category: str = "희소성", rules: Rules = PATTERNS, high_rating: float = 4) -> DataFrame:
    """"Good but hard to get": texts of the category among all, and with a high rating."""
    has = has_category(category, rules)
    counts = df.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(has).alias("scarcity_count"),
        F.count_if(has & (F.col("rating") >= high_rating)).alias("good_but_hard_count"),
    )
    zero = 0.0
    return counts.select(
        "*",
        ratio("scarcity_count", "total_count", zero).alias("scarcity_ratio"),
        ratio("good_but_hard_count", "total_count", zero).alias("good_but_hard_ratio"),
        ratio("good_but_hard_count", "scarcity_count", zero).alias("high_rating_ratio_in_scarcity"),
    )


def good_but_hard(df: DataFrame, category: str = "희소성", rules: Rules = PATTERNS, high_rating: float = 4) -> DataFrame:
    return df.where(has_category(category, rules) & (F.col("rating") >= high_rating))


def sample_texts(df: DataFrame, order_by: Sequence[str], n: int = 5, chars: int = 100, text: str = "text") -> DataFrame:
    return df.orderBy(*order_by).limit(n).withColumn(text, F.substring(text, 1, chars))


def star_keywords(df: DataFrame, stars: Sequence[float] = (1.0, 5.0), n: int = 30, words: str = "tokens") -> DataFrame:
    """Top keywords of the worst and of the best reviews."""
    out = None
    for s in stars:
        part = top_keywords(df.where(F.col("rating") == s), n, words).withColumn("rating", F.lit(float(s)))
        out = part if out is None else out.unionByName(part)
    return out


def star_categories(df: DataFrame, stars: Sequence[float] = (1.0, 5.0), rules: Rules = PATTERNS, negative: str = NEGATIVE_SUFFIX) -> DataFrame:
    """Category matches of the worst and best reviews with their share of that rating's matches."""
    kept = df.where(F.col("rating").isin(*stars))
    counts = category_frequency(kept, rules, by=["rating"])
    total = F.sum("frequency").over(Window.partitionBy("rating"))
    return counts.withColumn("pct", F.coalesce(ratio(F.col("frequency") * 100.0, total), F.lit(0.0))).withColumn(
        "is_negative", F.col("category").endswith(negative)
    )


def mention_rates(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per pattern group: share of texts that mention it and mean rating with and without."""
    flags = {n: F.coalesce(F.col("text").rlike(any_of(p, "(?U)")), F.lit(False)) for n, p in groups.items()}
    flagged = df.select("rating", *[f.alias(f"_f{i}") for i, f in enumerate(flags.values())])
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i in range(len(flags)):
        f = F.col(f"_f{i}")
        aggs += [
            F.count_if(f).alias(f"_k{i}"),
            F.avg(F.when(f, F.col("rating"))).alias(f"_w{i}"),
            F.avg(F.when(~f, F.col("rating"))).alias(f"_o{i}"),
        ]
    rows = [
        F.struct(
            F.lit(n).alias("mention"),
            F.col(f"_k{i}").alias("n_texts"),
            ratio(F.col(f"_k{i}") * 100.0, "_n").alias("pct"),
            F.col(f"_w{i}").alias("rating_with"),
            F.col(f"_o{i}").alias("rating_without"),
        )
        for i, n in enumerate(flags)
    ]
    return flagged.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mention_ratio(rates: DataFrame, over: str, under: str) -> DataFrame:
    """How many times more often one group is mentioned than another."""
    n = {m: F.max(F.when(F.col("mention") == m, F.col("n_texts"))) for m in (over, under)}
    return rates.agg(n[over].alias("_a"), n[under].alias("_b")).select(
        F.lit(f"{over}/{under}").alias("pair"), ratio("_a", "_b").alias("ratio")
    )


def reorder_report(df: DataFrame, complaints: Mapping[str, str], rules: Rules = PATTERNS, flag: str = "is_reorder") -> DataFrame:
    """Reorder group against the rest: share, mean rating, complaint shares."""
    shares = [
        (F.avg(F.when(has_category(category, rules), 100.0).otherwise(0.0))).alias(f"{name}_pct") for name, category in complaints.items()
    ]
    groups = df.groupBy(flag).agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("rating").alias("mean_rating"), *shares)
    return groups.withColumn("share_pct", F.col("n_reviews") * 100.0 / F.sum("n_reviews").over(Window.partitionBy()))


def group_top_categories(df: DataFrame, n: int = 3, rules: Rules = PATTERNS, flag: str = "is_reorder") -> DataFrame:
    counts = category_frequency(df, rules, by=[flag])
    return top_per_group(counts, [flag], [F.desc("frequency"), F.asc("category")], n)


def group_matrix(df: DataFrame, group: str, rules: Rules = PATTERNS) -> DataFrame:
    """Groups as rows, one column of matches per category."""
    sums = [F.sum(c).cast("long").alias(n) for n, c in pattern_counts(rules).items()]
    return df.groupBy(group).agg(*sums)


def rating_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "rating").agg(F.count(F.lit(1)).alias("n_reviews"))
