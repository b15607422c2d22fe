"""Toxicity by compression distance: windows of a text under a zstandard dictionary of toxic and one of ordinary text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.llm.common import settle, whole_text

WINDOW, STRIDE = 8, 4
#: letters of any script; on lower-cased UTF-8 bytes
_WORDS = re.compile(rb"[^\x00-\x60\x7b-\x7f]+")
_TRIPLES = "toxic int, word binary, context bigint"


def words_of(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.lower())


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights that turn a document's window differences into a probability."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # intercept first; empty: ``prior`` for every text
    prior: float = 0.0

    def compressors(self):
        level = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, write_content_size=False, write_dict_id=False)
        return [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=level
            ).compress
            for d in (self.ordinary, self.toxic)
        ]

    def probability(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + features @ w[1:], -30, 30)))


def features_of(text: bytes, plain, toxic) -> tuple[float, float, float]:
    """Of the bytes that the toxic dictionary saves in the text's windows: mean, largest, and log of windows.

    Only savings count; a text without words has one empty window.
    """
    words = words_of(text)
    gain = best = n = 0
    for i in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE):
        window = b" " + b" ".join(words[i : i + WINDOW]) + b" "
        saved = len(plain(window)) - len(toxic(window))
        n += 1
        if saved > 0:
            gain += saved
            best = max(best, saved)
    return gain / n, float(best), float(np.log(n))


def features(text: Column, model: Model) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = model.compressors()
        for part in texts:
            yield pd.Series([features_of(t, *pair) for t in part], dtype=object)

    return run(text.cast("binary"))


def _contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each word of a text with a hash of its two neighbours and itself, once per text."""
    digest = xxhash.xxh64_intdigest
    for part in parts:
        for toxic, text in zip(part["toxic"], part["text"]):
            w = words_of(text)
            if len(w) > 2:
                seen = set(zip(w, w[1:], w[2:]))
                yield pd.DataFrame(
                    {
                        "toxic": np.full(len(seen), toxic, "int32"),
                        "word": [t[1] for t in seen],
                        "context": np.array([digest(b" ".join(t)) for t in seen], np.uint64).view(np.int64),
                    }
                )


def dictionaries(sample: DataFrame, ordinary_words: int = 1500, toxic_words: int = 512) -> tuple[bytes, bytes]:
    """Raw-content dictionaries for ordinary and toxic text out of labelled texts (``toxic``, ``text`` binary).

    Words are counted by the different contexts they stand in, so that copies of a text count once. The
    ordinary dictionary holds the words with the most contexts in ordinary text, the best last, where matches
    are cheapest. The toxic one holds the same words and then those that toxic text prefers beyond chance
    (log-likelihood ratio, with room for having looked at every word), so a window differs only by these.
    """
    counted = settle(
        sample.mapInPandas(_contexts, _TRIPLES)
        .groupBy("word", "context")
        .agg(F.max("toxic").alias("t"), F.min("toxic").alias("o"))
        .groupBy("word")
        .agg(F.sum("t").alias("t"), F.sum(1 - F.col("o")).alias("o")),
        "words",
    )
    total = counted.agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), F.count_if(F.col("t") > 2).alias("looked")).first()
    common = counted.where("o > 0").orderBy(F.col("o").desc(), "word").limit(ordinary_words).collect()
    plain = b" " + b" ".join(bytes(r.word) for r in reversed(common)) + b" "
    nt, no = int(total.nt or 0), int(total.no or 0)
    if not nt or not no:
        return plain, plain
    t, o, n = F.col("t").cast("double"), F.col("o").cast("double"), float(nt + no)
    ratio = 2 * (t * F.log(t * n / ((t + o) * nt)) + F.when(o > 0, o * F.log(o * n / ((t + o) * no))).otherwise(0.0))
    told = (
        counted.where((t > 2) & (t * no > 4 * o * nt))
        .withColumn("g", ratio)
        .where(F.col("g") > 2 * float(np.log(max(2, total.looked))) + 12)
        .orderBy(F.col("g").desc(), "word")
        .limit(toxic_words)
        .collect()
    )
    return plain, plain + b" ".join(bytes(r.word) for r in reversed(told)) + b" " * bool(told)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Weights of a ridge logistic regression on standardised columns, given for the columns as they are."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / scale
    return (float(w[0] - slope @ mean), *map(float, slope))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 4000, ordinary_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``toxic_rows`` and ``ordinary_rows`` labelled documents (``labels``: doc_id, toxic).

    The rows are drawn by a hash of the id. Dictionaries and calibration come from these whole texts; only
    the dictionary words and three numbers a document reach the driver. An id that is labelled both ways is toxic;
    rows without an id or a label are left out.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw = [F.xxhash64("doc_id"), "doc_id"]
    chosen = marks.where("toxic = 1").orderBy(*draw).limit(toxic_rows).union(marks.where("toxic = 0").orderBy(*draw).limit(ordinary_rows))
    chosen = chosen.select(F.col("doc_id").alias("_llm_id"), "toxic")
    sample = settle(
        docs.join(F.broadcast(chosen), docs[id_col] == F.col("_llm_id")).select(F.col("_llm_id").alias("doc_id"), chosen.toxic, whole_text(docs, text_col).cast("binary").alias("text")),
        "toxicity-sample",
    ).repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism), "doc_id")
    plain, toxic = dictionaries(sample)
    model = Model(plain, toxic, ())
    rows = sample.select("toxic", features(F.col("text"), model).alias("f")).toPandas()
    y = rows["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(plain, toxic, (), float(y.mean()) if len(y) else 0.0)
    return Model(plain, toxic, logistic(np.array(rows["f"].tolist(), float), y))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The documents with the probability that they are toxic, a row for each row.

    NULL counts as the empty text, which is scored too; a long text is scored over all its windows; rows that repeat
    have the same score; an empty table stays empty. Other columns stay as they are, but one named ``out_col`` is
    replaced.
    """

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = model.compressors()
        for part in texts:
            found = np.array([features_of(t, *pair) for t in part], float).reshape(-1, 3)
            yield pd.Series(model.probability(found))

    return docs.withColumn(out_col, run(whole_text(docs, text_col).cast("binary")))
