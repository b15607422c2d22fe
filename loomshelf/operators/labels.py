"""Rule labelling of reviews, repair and routing of labels, scores, reports and cost."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.functions.columns import any_of, col
from loomshelf.functions.ranking import keep_first, null_safe_join

# Labels, keyword lists, limits, texts and prices of the labelling jobs, in given order.
SENTIMENTS = ["negative", "neutral", "positive"]
UNCLASSIFIED = "미분류"
ASPECT_KEYWORDS = {
    "배송/포장": ["배송", "포장", "도착", "택배", "빠르", "느리", "박스", "파손", "뽁뽁이", "안전하게", "꼼꼼", "늦", "빨리"],
    "품질/퀄리티": ["품질", "퀄리티", "질", "싸구려", "고급", "저렴해보", "허접", "튼튼", "약해", "부실"],
    "가격/가성비": ["가격", "가성비", "싸", "저렴", "비싸", "값", "돈", "원", "할인", "세일", "득템", "이 가격에"],
    "사용감/성능": [
        "발림", "흡수", "지속", "커버", "효과", "촉촉", "건조", "당김", "따가", "자극", "순해", "끈적", "산뜻", "무거", "가벼",
        "밀림", "뭉침", "들뜸", "착붙", "밀착", "보습", "수분", "촉촉",
    ],
    "용량/휴대": ["용량", "양", "많", "적", "작", "크", "휴대", "들고다니", "파우치", "여행", "ml", "g", "개입"],
    "디자인": ["디자인", "예쁘", "귀엽", "이쁘", "예뻐", "디자인", "모양", "생김", "멋", "세련"],
    "재질/냄새": ["냄새", "향", "향기", "냄시", "쿰쿰", "비릿", "플라스틱", "재질", "질감", "텍스처", "알코올", "무향", "화학"],
    "CS/응대": ["고객", "응대", "문의", "답변", "교환", "환불", "서비스", "CS", "친절"],
    "재구매": ["재구매", "또 사", "또사", "쟁여", "정착", "계속 쓸", "앞으로", "다음에도", "재주문", "추가 구매", "더 살", "스톡"],
    "색상/발색": [
        "발색", "색", "컬러", "톤", "밝", "어두", "진하", "연하", "핑크", "레드", "베이지", "브라운", "코랄", "누드", "웜톤", "쿨톤",
        "화사", "생기",
    ],
}
POSITIVE_WORDS = [
    "좋", "최고", "만족", "예쁘", "이쁘", "굿", "짱", "대박", "추천", "완벽", "사랑", "훌륭", "믿고", "꿀", "인생", "갓", "good", "best",
    "👍", "❤", "😍", "♡", "잘 샀", "득템", "착붙", "촉촉", "산뜻", "순해", "가벼", "빠르", "꼼꼼", "깔끔",
]
NEGATIVE_WORDS = [
    "별로", "안 좋", "실망", "후회", "최악", "싫", "나쁘", "아쉽", "그냥", "그저", "안맞", "안 맞", "트러블", "뒤집", "따가", "자극", "건조",
    "당김", "끈적", "무거", "밀림", "뭉침", "들뜸", "늦", "느려", "파손", "빠짐", "깨짐", "없어", "안 와", "연하", "안 남", "없음", "글쎄",
    "음...", "흠...",
]
NEUTRAL_WORDS = ["보통", "무난", "그럭저럭", "평범", "그냥저냥", "쓸만", "나쁘지 않", "괜찮"]
RISK_WORDS = [
    "별로", "최악", "다시는", "환불", "불친절", "늦", "안좋", "안 좋", "실망", "후회", "짜증", "불량", "파손", "망", "싫", "아쉽", "거짓",
    "속았", "사기", "엉망", "쓰레기", "버림", "못씀", "안됨", "고장",
]
CONTRAST_MARKERS = ["지만", "는데", "으나", "나", "만", "그러나", "하지만", "근데"]
LONG_TEXT, DOUBTFUL = 50, (0.3, 0.5)
MIN_CONFIDENCE, DEFAULT_CONFIDENCE = 0.7, 0.8
REASON_PREFIX, NO_REASON, NO_ASPECT_REASON = "키워드 매칭: ", "일반적 표현", "확실한 Aspect 없음"
SUMMARY_WORDS = {"positive": "긍정적", "neutral": "중립적", "negative": "부정적"}
HIERARCHY = {
    "사용 체감": ["사용감/성능", "재질/냄새"],
    "외관·표현 성능": ["색상/발색", "디자인"],
    "물리적 가치": ["용량/휴대", "품질/불량"],
    "가격 가치": ["가격/가성비"],
    "재구매 의도": ["재구매"],
    "배송·유통 경험": ["배송/포장"],
    "고객 응대 경험": ["CS/응대"],
}
# price per 1,000 input and output tokens by model name
PRICES = {
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o": (0.0025, 0.01),
    "gpt-4.1-mini": (0.0004, 0.0016),
    "gpt-4.1": (0.001, 0.004),
}

Rules = Mapping[str, Sequence[str]]


def _hits(text: Column, words: Sequence[str]) -> Column:
    """How many list entries the text contains; an entry listed twice counts twice."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(text.contains(w), 1).otherwise(0)
    return total


def with_rule_aspects(df: DataFrame, rules: Rules = ASPECT_KEYWORDS, top: int = 3, text: str = "text", out: str = "aspects") -> DataFrame:
    """Up to three aspects by keyword hits, ties in dictionary order; none → unclassified at 0.5.

    Built in steps (lowered text, matches per aspect, ranking) so that no step is evaluated twice.
    """
    names = list(rules)
    matched = {
        f"_m{i}": F.array_compact(F.array(*[F.when(F.col("_low").contains(w), F.lit(w)) for w in rules[name]]))
        for i, name in enumerate(names)
    }
    candidates = [
        F.struct(
            (-F.size(f"_m{i}")).alias("rank"), F.lit(i).alias("position"), F.lit(name).alias("aspect"), F.col(f"_m{i}").alias("matched")
        )
        for i, name in enumerate(names)
    ]
    found = F.slice(F.array_sort(F.filter(F.array(*candidates), lambda c: c["rank"] < 0)), 1, top)
    labels = F.transform(
        "_found",
        lambda c: F.struct(
            c["aspect"].alias("aspect"),
            F.round(F.least(F.lit(0.9), F.lit(0.5) - c["rank"] * F.lit(0.15)), 2).alias("confidence"),
            F.concat(F.lit(REASON_PREFIX), F.array_join(F.slice(c["matched"], 1, 3), ", ")).alias("reason"),
        ),
    )
    nothing = F.array(F.struct(F.lit(UNCLASSIFIED).alias("aspect"), F.lit(0.5).alias("confidence"), F.lit(NO_REASON).alias("reason")))
    return (
        df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumns(matched)
        .drop("_low")
        .withColumn("_found", found)
        .drop(*matched)
        .withColumn(out, F.when(F.size("_found") > 0, labels).otherwise(nothing))
        .drop("_found")
    )


def with_rule_sentiment(
    df: DataFrame,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
    neutral: Sequence[str] = NEUTRAL_WORDS,
    text: str = "text",
    rating: str = "rating",
) -> DataFrame:
    """sentiment and sentiment_score: strict majority of keyword hits plus a rating boost, else neutral."""
    low, r = F.col("_low"), F.col(rating)
    pos, neg, neu = F.col("_pos"), F.col("_neg"), F.col("_neu")
    wins_pos, wins_neg = (pos > neg) & (pos > neu), (neg > pos) & (neg > neu)
    score = F.when(wins_pos, F.least(F.lit(1.0), F.lit(0.5) + pos * F.lit(0.1))).when(
        wins_neg, F.greatest(F.lit(-1.0), F.lit(-0.5) - neg * F.lit(0.1))
    )
    return (
        df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumns(
            {
                "_pos": _hits(low, positive) + F.when(r >= 4, 2).otherwise(0),
                "_neg": _hits(low, negative) + F.when(r <= 2, 2).otherwise(0),
                "_neu": _hits(low, neutral) + F.when(r == 3, 1).otherwise(0),
            }
        )
        .drop("_low")
        .withColumns(
            {
                "sentiment": F.when(wins_pos, "positive").when(wins_neg, "negative").otherwise("neutral"),
                "sentiment_score": F.round(F.coalesce(score, F.lit(0.0)), 2),
            }
        )
        .drop("_pos", "_neg", "_neu")
    )


def _cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


Labeller = Callable[[DataFrame], DataFrame]


def rule_labeller(aspects: Rules = ASPECT_KEYWORDS, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS, neutral=NEUTRAL_WORDS) -> Labeller:
    return lambda df: with_rule_sentiment(with_rule_aspects(df, aspects), positive, negative, neutral)


def label_reviews(reviews: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """Sentiment, score, aspects, evidence and summary per review.

    A labeller adds ``aspects`` (array of aspect, confidence, reason), ``sentiment`` and
    ``sentiment_score``; any model wrapped in a pandas UDF or ``mapInPandas`` can take the place of the
    built-in rules.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with_sentiment = F.transform(
        "aspects",
        lambda a: F.struct(
            a["aspect"].alias("aspect"), F.col("sentiment").alias("sentiment"), a["confidence"].alias("confidence"), a["reason"].alias("reason")
        ),
    )
    return (
        (labeller or rule_labeller())(reviews)
        .withColumns({"aspect_labels": with_sentiment, "evidence": _cut(text, 100), "summary": _cut(text, 30)})
        .drop("aspects")
    )


def explode_labels(labelled: DataFrame) -> DataFrame:
    """One row per review and aspect; every review has at least one (unclassified)."""
    return labelled.withColumn("_l", F.explode_outer("aspect_labels")).select(
        *[c for c in labelled.columns if c not in ("aspect_labels", "sentiment")],
        F.col("sentiment").alias("overall_sentiment"),
        F.col("_l.aspect").alias("aspect"),
        F.col("_l.sentiment").alias("aspect_sentiment"),
        F.col("_l.confidence").alias("aspect_confidence"),
        F.col("_l.reason").alias("aspect_reason"),
    )


def _clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


LABEL_FIELDS = ["sentiment", "sentiment_score", "aspect_labels", "evidence", "summary"]


def repair_labels(df: DataFrame, content: str = "content", aspects: Sequence[str] = (*ASPECT_KEYWORDS, UNCLASSIFIED)) -> DataFrame:
    """Check and mend label JSON. Rows without a required field or a numeric score are not ``valid``.

    A bad sentiment is read off the score, score and confidence are clipped, doubtful and unknown
    aspects are dropped, plain aspect names are upgraded, and nothing left becomes unclassified.
    """
    raw = "sentiment string, sentiment_score string, aspect_labels array<string>, evidence string, summary string"
    item_schema = "aspect string, sentiment string, confidence double, reason string"
    parsed = df.withColumn("_p", F.from_json(content, raw)).withColumn("_keys", F.expr(f"json_object_keys({content})"))
    score = F.col("_p.sentiment_score").try_cast("double")
    complete = F.coalesce(F.size(F.array_intersect("_keys", F.array(*[F.lit(f) for f in LABEL_FIELDS]))) == len(LABEL_FIELDS), F.lit(False))
    known = F.array(*[F.lit(a) for a in aspects])
    given = F.col("_p.sentiment")
    sentiment = F.when(given.isin(*SENTIMENTS), given).when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")

    def mend(item: Column) -> Column:
        as_object = F.from_json(item, item_schema)
        is_object = F.startswith(F.trim(item), F.lit("{"))
        label = as_object["sentiment"]
        from_object = F.struct(
            as_object["aspect"].alias("aspect"),
            F.when(label.isin(*SENTIMENTS), label).otherwise("neutral").alias("sentiment"),
            _clip(F.coalesce(as_object["confidence"], F.lit(DEFAULT_CONFIDENCE)), 0.0, 1.0).alias("confidence"),
            F.coalesce(as_object["reason"], F.lit("")).alias("reason"),
        )
        from_name = F.struct(
            item.alias("aspect"), F.col("_sentiment").alias("sentiment"), F.lit(DEFAULT_CONFIDENCE).alias("confidence"), F.lit("").alias("reason")
        )
        return F.when(is_object, from_object).otherwise(from_name)

    fallback = F.array(
        F.struct(
            F.lit(UNCLASSIFIED).alias("aspect"), F.lit("neutral").alias("sentiment"), F.lit(1.0).alias("confidence"), F.lit(NO_ASPECT_REASON).alias("reason")
        )
    )
    sure = F.filter(
        "_items",
        lambda a: F.array_contains(known, a["aspect"]) & ((a["confidence"] >= MIN_CONFIDENCE) | (a["aspect"] == UNCLASSIFIED)),
    )
    items = F.coalesce(F.col("_p.aspect_labels"), F.array().cast("array<string>"))
    filled = {f: F.coalesce(F.when(F.trim(F.col(f"_p.{f}")) != "", F.col(f"_p.{f}")), F.lit("N/A")) for f in ("evidence", "summary")}
    return (
        parsed.withColumn("valid", complete & score.isNotNull())
        .withColumn("_sentiment", sentiment)
        .withColumn("_items", F.transform(items, mend))
        .withColumn("_sure", sure)
        .select(
            *df.columns,
            "valid",
            F.when(F.col("valid"), F.col("_sentiment")).alias("sentiment"),
            F.when(F.col("valid"), _clip(score, -1.0, 1.0)).alias("sentiment_score"),
            F.when(F.col("valid"), F.when(F.size("_sure") > 0, F.col("_sure")).otherwise(fallback)).alias("aspect_labels"),
            *[F.when(F.col("valid"), c).alias(n) for n, c in filled.items()],
        )
    )


def repair_judgements(df: DataFrame, content: str = "content", aspects: Sequence[str] = (*ASPECT_KEYWORDS, UNCLASSIFIED)) -> DataFrame:
    """Check and mend judge JSON: judgement, issues, confidence, reason and the corrected label."""
    schema = (
        "judgment string, issues array<string>, confidence string, reason string, "
        "fixed_label struct<sentiment:string,aspect_labels:array<string>>"
    )
    p = F.col("_p")
    known = F.array(*[F.lit(a) for a in aspects])
    judgement = F.when(p["judgment"].isin("ok", "fix", "uncertain"), p["judgment"]).otherwise("uncertain")
    fixing = judgement == "fix"
    label = p["fixed_label"]["sentiment"]
    fixed_aspects = p["fixed_label"]["aspect_labels"]
    return df.withColumn("_p", F.from_json(content, schema)).select(
        *df.columns,
        judgement.alias("judgment"),
        F.coalesce(p["issues"], F.array().cast("array<string>")).alias("issues"),
        _clip(F.coalesce(p["confidence"].try_cast("double"), F.lit(0.5)), 0.0, 1.0).alias("confidence"),
        F.coalesce(p["reason"], F.lit("")).alias("reason"),
        F.when(~fixing | label.isin(*SENTIMENTS), label).alias("fixed_sentiment"),
        F.when(fixing, F.filter(fixed_aspects, lambda a: F.array_contains(known, a))).otherwise(fixed_aspects).alias("fixed_aspects"),
    )


def needs_review(confidence: str = "confidence", rating: str = "rating", sentiment: str = "sentiment") -> Column:
    """Low confidence, or a sentiment against the stars."""
    r, s = F.col(rating), F.col(sentiment)
    return (F.col(confidence) < MIN_CONFIDENCE) | ((r >= 4) & (s == "negative")) | ((r <= 2) & (s == "positive"))


LABEL_KEYS = ("order_id", "aspect")


def by_text_head(labels: DataFrame) -> DataFrame:
    """Name a label by the first 100 characters of its review, for queues whose reviews lost their id.

    Reviews with the same opening are then one: pass ``keys=("text_head", "aspect")`` only where that is meant.
    """
    return labels.withColumn("text_head", F.substring("text", 1, 100))


def review_queue(labels: DataFrame, order_by: Sequence[str], keys: Sequence[str] = LABEL_KEYS) -> DataFrame:
    """Doubtful labels, one per review and aspect."""
    return keep_first(labels.where(needs_review()), list(keys), order_by)


def merge_reviewed(labels: DataFrame, reviewed: DataFrame, keys: Sequence[str] = LABEL_KEYS, remove: str = "REMOVE") -> DataFrame:
    """Put re-reviewed sentiment, confidence and model in place; a removed label loses its row.

    A review without a sentiment has decided nothing: the label stays as it was.
    """
    fixes = reviewed.where(F.col("sentiment").isNotNull()).select(
        *keys,
        F.col("sentiment").alias("_sentiment"),
        F.col("confidence").alias("_confidence"),
        F.col("model").alias("_model"),
    )
    hit = F.col("_sentiment").isNotNull()
    return (
        null_safe_join(labels, fixes, list(keys), "left")
        .where(~hit | (F.col("_sentiment") != remove))
        .withColumns(
            {
                "sentiment": F.coalesce("_sentiment", "sentiment"),
                "confidence": F.when(hit, F.col("_confidence")).otherwise(F.col("confidence")),
                "model": F.when(hit, F.col("_model")).otherwise(F.col("model")),
            }
        )
        .drop("_sentiment", "_confidence", "_model")
    )


def encode_labels(labelled: DataFrame, aspects: Sequence[str], sentiments: Sequence[str] = SENTIMENTS) -> DataFrame:
    """sentiment_id and 0/1 vector over the aspect list; rows with an unknown sentiment drop out."""
    ids = F.array_position(F.array(*[F.lit(s) for s in sentiments]), F.col("sentiment")) - 1
    names = F.transform("aspect_labels", lambda a: a["aspect"])
    vector = F.transform(F.array(*[F.lit(a) for a in aspects]), lambda a: F.array_contains(names, a).cast("int"))
    return labelled.where(F.col("sentiment").isin(*sentiments)).withColumns(
        {"sentiment_id": ids.cast("int"), "aspect_vector": vector}
    )


def class_weights(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """total / (k · count) per class, 0 for a class without rows."""
    names = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string")
    counts = df.where(F.col(label).isin(*classes)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    joined = names.join(counts, label, "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return joined.select(label, n.alias("n"), F.when(n > 0, F.col("_total") / (n * len(classes))).otherwise(F.lit(0.0)).alias("weight"))


def score_probabilities(
    df: DataFrame,
    aspects: Sequence[str],
    threshold: float = 0.5,
    sure: float = 0.6,
    grey: tuple[float, float] = (0.4, 0.6),
) -> DataFrame:
    """Read model probabilities: label, score = P(positive) − P(negative), aspects, ambiguity flag."""
    probs = F.col("sentiment_probs")
    best = F.array_max(probs)
    pairs = F.arrays_zip(F.array(*[F.lit(a) for a in aspects]).alias("aspect"), F.col("aspect_probs").alias("p"))
    chosen = F.transform(F.filter(pairs, lambda x: x["p"] >= threshold), lambda x: x["aspect"])
    unsure = (best < sure) | F.exists("aspect_probs", lambda p: (p >= grey[0]) & (p <= grey[1]))
    return df.withColumns(
        {
            "sentiment": F.element_at(F.array(*[F.lit(s) for s in SENTIMENTS]), F.array_position(probs, best).cast("int")),
            "sentiment_score": F.get(probs, F.lit(2)) - F.get(probs, F.lit(0)),
            "sentiment_confidence": best,
            "aspects": chosen,
            "is_ambiguous": unsure,
        }
    )


def template_summary(sentiment: str | Column = "sentiment", aspects: str | Column = "aspects", words: Mapping[str, str] = SUMMARY_WORDS) -> Column:
    s, names = col(sentiment), col(aspects)
    word = s
    for label, translated in words.items():
        word = F.when(s == label, F.lit(translated)).otherwise(word)
    listed = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, " 등").otherwise(""))
    return F.when(F.size(names) == 0, F.concat(F.lit("전반적으로 "), s)).otherwise(F.concat(listed, F.lit("에 대해 "), word))


def roll_up(scores: DataFrame, key: str, hierarchy: Rules = HIERARCHY) -> DataFrame:
    """Parent score = highest score of its leaves; a leaf may have several parents."""
    rows = [(parent, leaf) for parent, leaves in hierarchy.items() for leaf in leaves]
    table = scores.sparkSession.createDataFrame(rows, "parent string, aspect string")
    return scores.join(F.broadcast(table), "aspect").groupBy(key, "parent").agg(F.max("score").alias("score"))


def sentiment_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n_reviews"))


def aspects_per_review(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(F.size("aspect_labels").alias("n_aspects")).agg(F.count(F.lit(1)).alias("n_reviews"))


def aspect_sentiment_pivot(long_labels: DataFrame, sentiments: Sequence[str] = SENTIMENTS) -> DataFrame:
    return long_labels.groupBy("aspect").agg(
        *[F.count_if(F.col("aspect_sentiment") == s).alias(s) for s in sentiments], F.count(F.lit(1)).alias("total")
    )


def not_yet_labelled(reviews: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return reviews.join(labels.select(key).distinct(), key, "left_anti")


def cache_key(*parts: str | Column) -> Column:
    """Content hash under which a label can be used again."""
    return F.md5(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]))


def reuse_labels(reviews: DataFrame, cache: DataFrame, *parts: str | Column) -> DataFrame:
    """Attach cached labels by content hash; ``cache_hit`` says whether there was one."""
    hits = cache.withColumn("cache_hit", F.lit(True))
    return (
        reviews.withColumn("cache_key", cache_key(*parts))
        .join(hits, "cache_key", "left")
        .withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))
    )


def labelling_cost(labels: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES) -> DataFrame:
    """Tokens and cost per model tier, with the mean cost per label. A model without a price has NULL costs."""
    rows = [(m, i, o) for m, (i, o) in prices.items()]
    table = labels.sparkSession.createDataFrame(rows, "model string, _in double, _out double")
    sums = labels.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output")
    )
    cost = (F.col("tokens_input") * F.col("_in") + F.col("tokens_output") * F.col("_out")) / 1000
    return (
        sums.join(F.broadcast(table), "model", "left")
        .withColumn("cost", cost)
        .withColumn("mean_cost", F.col("cost") / F.col("n_labels"))
        .drop("_in", "_out")
    )


def risk_reasons(
    text: str = "text",
    rating: str = "rating",
    sentiment: str = "sentiment",
    confidence: str = "confidence",
    negative: Sequence[str] = RISK_WORDS,
    contrast: Sequence[str] = CONTRAST_MARKERS,
) -> Column:
    """Why a label should be looked at again, as a list of reasons."""
    t, r, s, c = F.coalesce(F.col(text), F.lit("")), F.col(rating), F.col(sentiment), F.col(confidence)
    expected = F.when(r <= 2, "negative").when(r == 3, "neutral").when(r >= 4, "positive")

    def contains(words: Sequence[str]) -> Column:
        return t.rlike(any_of([re.escape(w) for w in words], ""))

    flags = {
        "rating_mismatch": s != expected,
        "negative_keyword": contains(negative) & (s != "negative"),
        "contrast": contains(contrast),
        "long_text": F.length(t) >= LONG_TEXT,
        "low_confidence": c.between(*DOUBTFUL),
    }
    return F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]))
