"""Interpolated modified Kneser-Ney over the bytes of UTF-8 text, with counts, probabilities and scores as tables.

A text is its bytes, unfolded, after ``ORDER`` zeros and before a byte that UTF-8 does not have. An n-gram of up to
``ORDER`` bytes is one number that holds its bytes, its order and its model, so nothing is hashed and no vocabulary
or alphabet bounds the tables.

Texts are dealt to two models by their hash, and each is scored by the model of the other half: no text is scored
by a model that counted it, or the trusted ones would all look better than what they are compared with.

The log probability of a text is a sum of one number per occurrence of an n-gram of any order: what the n-gram gains
over its back-off, and, as the context of what follows, its own back-off weight. An n-gram that was never seen adds
nothing, so an inner join on the n-gram finds all that counts. The join is sharded by n-gram and split for its heavy
hitters: n-grams that make up ``HOT_SHARE`` or more, ``HOT`` at most, are met where the text is read; of the others a
text sends only those that a filter of fixed size does not rule out, one row for each n-gram of a batch of texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.llm.common import forget, settle

ORDER = 6
#: Bytes before and after a text.
START, END = 0, 255
#: Share of all counted bytes from which an n-gram is frequent, n-grams that every task holds at most, and bits of
#: the filter over the others. By the share, what texts send is in proportion to them at every size.
HOT_SHARE, HOT, FILTER_BITS = 2.5e-8, 2_000_000, 1 << 26
#: Bytes of text that are counted or scored at once in a task, and rows in a batch that it hands back.
CHUNK, BATCH = 1_000_000, 50_000
_MODEL, _TAG = 56, 48
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps


def tag(model: int, order: int) -> int:
    return model << _MODEL | order << _TAG


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def model_of(text_hash: Column) -> Column:
    """The model that counts a text."""
    return text_hash.bitwiseAND(F.lit(1)).cast("int")


def _pieces(texts: Iterator[tuple[tuple, bytes, int]], lead: int) -> Iterator[tuple[list[bytes], list[tuple], np.ndarray]]:
    """Texts with what stands around them, up to ``CHUNK`` bytes at once: pieces, their names and symbols, their models.

    Each piece starts with the ``ORDER - 1`` bytes before its own, so a text longer than a chunk can be cut anywhere.
    The first ``lead`` own bytes of a text are marks before it and no symbols.
    """
    held, names, models, size = [], [], [], 0
    for name, text, model in texts:
        whole = bytes([START]) * (ORDER - 1 + lead) + text + bytes([END])
        for at in range(ORDER - 1, len(whole), CHUNK):
            piece = whole[at - ORDER + 1 : at + CHUNK]
            held.append(piece)
            names.append((*name, len(piece) - ORDER + 1 - (lead if at < ORDER else 0)))
            models.append(model)
            size += len(piece)
            if size >= CHUNK:
                yield held, names, np.array(models)
                held, names, models, size = [], [], [], 0
    if held:
        yield held, names, np.array(models)


def _codes(pieces: list[bytes], models: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of the highest order that ends at each own byte of the pieces, and the number of its piece."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    x = np.frombuffer(b"".join(pieces), np.uint8)
    code = np.zeros(len(x) - ORDER + 1, np.int64)
    for i in range(ORDER):
        code <<= 8
        code |= x[i : i + len(code)]
    ends = np.cumsum(sizes)
    own = np.ones(len(code), bool)  # windows that lie within one piece
    for i in range(1, ORDER):
        own[ends[:-1] - i] = False
    at = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes - ORDER + 1)
    code = code[own]
    code |= (models.astype(np.int64) << _MODEL | ORDER << _TAG)[at]
    return code, at


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (((), text.as_py(), model) for part in parts for text, model in zip(part["text"], part["model"].to_pylist()))
    for pieces, _, models in _pieces(rows, 0):
        codes, keys = pd.factorize(_codes(pieces, models)[0])
        n = np.bincount(codes, minlength=len(keys))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        for i in range(0, len(keys), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + BATCH]), pa.array(n[i : i + BATCH])], ["key", "n"])


def _discounts(counts: DataFrame) -> Column:
    """Discount of a count by model and order, for counts of 1, 2 and 3 or more."""
    d = F.lit(None).cast("double")
    name = F.shiftright("key", _TAG)
    for r in counts.groupBy(name.alias("name")).agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).collect():  # twelve rows
        n1, n2, n3, n4 = r[1:]
        if min(n1, n2, n3, n4) > 0:
            y = n1 / (n1 + 2 * n2)
            # above zero, so that every context leaves something to what was never seen
            one, two, more = (max(0.1, min(i, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        else:  # too few different counts to estimate
            one, two, more = 0.5, 0.75, 0.75
        d = F.when(name == r["name"], F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)).otherwise(d)
    return d


def _shorter(order: int) -> Column:
    """The n-gram of ``order`` that one of the next order ends with."""
    return F.col("key").bitwiseAND(F.lit(1 << _MODEL | _mask(order))).bitwiseOR(F.lit(order << _TAG))


def _context(order: int) -> Column:
    """What stands before the last byte of an n-gram of ``order``."""
    return F.shiftright("key", 8).bitwiseAND(F.lit(_mask(order - 1))).bitwiseOR(F.col("key").bitwiseAND(F.lit(1 << _MODEL))).bitwiseOR(F.lit(order - 1 << _TAG))


@dataclass(frozen=True)
class Model:
    """What each n-gram adds to a log probability: the frequent ones in files for every task, the others as a table."""

    hot: DataFrame  # ``key``, ``adds``
    bitmaps: DataFrame  # filter over the others: ``bucket``, ``bits``
    rest: DataFrame  # ``key``, ``adds``
    base: dict[int, float]  # by model: log probability of a byte that was never seen

    def forget(self) -> None:
        for table in (self.hot, self.bitmaps, self.rest):
            forget(table)


def train(trusted: DataFrame, hot: int = HOT, hot_share: float = HOT_SHARE) -> Model | None:
    """The model of all trusted texts (``text``, ``text_hash``); None if there is no text.

    Every n-gram of every text is counted, in the model of its text, over whole texts of any length.
    """
    texts = trusted.select(F.col("text").cast("binary").alias("text"), model_of(F.col("text_hash")).alias("model"))
    counted = texts.mapInArrow(_counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    levels = [settle(counted.select("key", "n", F.col("n").alias("heat")), "grams")]
    for order in range(ORDER - 1, 0, -1):  # below the highest order an n-gram counts the different bytes before it
        lower = levels[-1].groupBy(_shorter(order).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("heat").alias("heat"))
        levels.append(settle(lower, "grams"))
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    d = _discounts(every)
    total = levels[0].agg(F.sum("n")).first()[0] or 0  # one number
    known, probabilities, base = [], None, {}
    for order, level in enumerate(reversed(levels), 1):
        # a context has 256 rows at most
        own = Window.partitionBy("context")
        rows = level.select("key", "n", "heat", _context(order).alias("context"), d.alias("d"))
        rows = rows.select("key", "heat", "context", (F.sum("d").over(own) / F.sum("n").over(own)).alias("weight"), ((F.col("n") - F.col("d")) / F.sum("n").over(own)).alias("own"))
        if probabilities is None:
            back, joined = F.lit(1 / 256), rows
        else:
            lower = probabilities.select(F.col("key").alias("_key"), F.col("p").alias("_p"))
            back, joined = F.col("_p"), rows.withColumn("_short", _shorter(order - 1)).join(lower, F.col("_short") == F.col("_key"))
        backed = F.col("weight") * back
        probabilities = settle(joined.select("key", "heat", "context", F.log("weight").alias("weight"), (F.col("own") + backed).alias("p"), F.log((F.col("own") + backed) / backed).alias("gain")), "probabilities")
        known.append(probabilities)
        forget(level)
    for r in known[0].groupBy("context").agg(F.first("weight").alias("weight")).collect():  # a row for each model
        base[r["context"] >> _MODEL] = float(r["weight"] - np.log(256))
    parts = None
    for order, level in enumerate(known, 1):
        gains = level.select("key", F.col("gain").alias("adds"), "heat")
        if order > 1:  # the context of no byte at all is in ``base``
            contexts = level.groupBy(F.col("context").alias("key")).agg(F.first("weight").alias("adds"))
            # contexts that are no n-grams are the beginnings of texts
            gains = gains.unionByName(contexts.withColumn("heat", F.when(F.col("key").bitwiseAND(F.lit(_mask(ORDER))) == 0, F.lit(1 << 62)).otherwise(0)))
        parts = gains if parts is None else parts.unionByName(gains)
    table = settle(parts.groupBy("key").agg(F.sum("adds").alias("adds"), F.max("heat").alias("heat")), "adds")
    for level in known:
        forget(level)
    if not base:
        return None
    # the least heat that every task holds, from the sizes of at most a few hundred bins
    warmth = F.floor(F.log2(F.greatest("heat", F.lit(1))) * 8)
    least, held = None, 0
    frequent = table.where(F.col("heat") >= total * hot_share)
    for r in sorted(frequent.groupBy(warmth.alias("warmth")).count().collect(), reverse=True):
        held += r["count"]
        if held > hot:
            break
        least = r["warmth"]
    is_hot = (warmth >= least) & (F.col("heat") >= total * hot_share) if least is not None else F.lit(False)
    frequent = settle(table.where(is_hot).select("key", F.col("adds").cast("float").alias("adds")), "hot-grams")
    rest = settle(table.where(~is_hot).select("key", "adds"), "grams")
    bits = rest.select("key").mapInArrow(_bits, "bucket int, bit bigint")
    bitmaps = settle(bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter")
    forget(table)
    return Model(frequent, bitmaps, rest, base)


def _places(keys: np.ndarray) -> np.ndarray:
    """Bit of the filter for each n-gram."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _bits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        places = np.unique(_places(part["key"].to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array((places // _BITMAP).astype(np.int32)), pa.array(places % _BITMAP)], ["bucket", "bit"])


def _read(paths: tuple[str, ...], columns: tuple[str, str]) -> list[tuple]:
    """Both columns of each file, as arrays."""
    out = []
    for uri in paths:
        files, path = fs.FileSystem.from_uri(uri)
        table = pq.read_table(path, filesystem=files)
        out.append(tuple(table[c] for c in columns))
    return out


@lru_cache(maxsize=1)
def _tables(hot_paths: tuple[str, ...], filter_paths: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What every task holds: the frequent n-grams in order, what they add, and the filter over the others."""
    hot = _read(hot_paths, ("key", "adds"))
    keys = np.concatenate([np.zeros(0, np.int64), *(k.to_numpy() for k, _ in hot)])
    adds = np.concatenate([np.zeros(0, np.float32), *(a.to_numpy() for _, a in hot)])
    order = np.argsort(keys)
    bits = np.zeros((FILTER_BITS // _BITMAP, _BITMAP // 8), np.uint8)
    for buckets, maps in _read(filter_paths, ("bucket", "bits")):
        for bucket, own in zip(buckets.to_pylist(), maps.to_pylist()):
            bits[bucket, : len(own)] = np.frombuffer(own, np.uint8)
    return keys[order], adds[order], bits.reshape(-1)


def _added(codes: np.ndarray, at: np.ndarray, texts: int, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Per text what frequent n-grams add; and the n-grams that may be among the others: n-gram, text, times."""
    hot, adds, bits = tables
    each, keys = pd.factorize(codes)
    back, value, sent = np.arange(len(keys)), np.zeros(len(keys)), []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            keys, up = np.unique(keys & (1 << _MODEL | _mask(order)) | order << _TAG, return_inverse=True)
            back = up[back]
        found = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
        hit = hot[found] == keys if len(hot) else np.zeros(len(keys), bool)
        value += np.where(hit, adds[found] if len(hot) else 0, 0)[back]
        place = _places(keys)
        maybe = ~hit & (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        if maybe.any():
            where = np.flatnonzero(maybe[back][each])
            pairs, times = np.unique(back[each[where]].astype(np.int64) * texts + at[where], return_counts=True)
            sent.append((keys[pairs // texts], pairs % texts, times))
    return np.bincount(at, value[each], texts), sent


#: What scoring hands back: a piece of a text with what its frequent n-grams add, or another n-gram and where it stands.
_LISTS = [("key", pa.int64()), ("texts", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]


def _scored(hot_paths: tuple[str, ...], filter_paths: tuple[str, ...]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 33)  # a number for each text
        types: list[tuple[str, pa.DataType]] = []

        def texts() -> Iterator[tuple[tuple, bytes, int]]:
            for part in parts:
                names = ("doc_id", "lang", "text_hash")
                types[:] = [("text_no", pa.int64()), *((c, part.schema.field(c).type) for c in names), ("symbols", pa.int64()), ("own", pa.float64())]
                columns = [part[c].to_pylist() for c in (*names, "model")]
                for text, *name, model in zip(part["text"], *columns):
                    yield (next(number), *name), text.as_py(), model

        for pieces, names, models in _pieces(texts(), 1):
            own, sent = _added(*_codes(pieces, models), len(pieces), _tables(hot_paths, filter_paths))
            schema = pa.schema(types + _LISTS)
            columns = [pa.array(c, t) for c, (_, t) in zip((*zip(*names), own), types)]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(names), t) for _, t in _LISTS], schema=schema)
            numbers = columns[0].to_numpy()
            for keys, at, times in sent:
                begins = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
                for i in range(0, len(begins) - 1, BATCH):
                    cut = begins[i : i + BATCH + 1]
                    lists = [pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(x[cut[0] : cut[-1]])) for x in (numbers[at], times.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(cut) - 1, t) for _, t in types] + [pa.array(keys[cut[:-1]]), *lists], schema=schema)

    return run


def scoring_model(text_hash: Column, base: dict[int, float]) -> Column:
    """The model that scores a text: not the one that counts it, unless there is only one."""
    return 1 - model_of(text_hash) if len(base) == 2 else F.lit(next(iter(base)))


def log_perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """Mean negative log probability of a byte, the end of the text with it: ``doc_id``, ``lang``, ``text_hash``, ``log_perplexity``.

    ``docs`` has these and ``text``; NULL for an empty text. The result is written.
    """
    by = scoring_model(F.col("text_hash"), model.base).cast("int")
    kind = docs.schema["doc_id"].dataType.simpleString()
    paths = [tuple(sorted(t.inputFiles())) for t in (model.hot, model.bitmaps)]
    texts = docs.select("doc_id", "lang", "text_hash", F.col("text").cast("binary").alias("text"), by.alias("model"))
    schema = f"text_no bigint, doc_id {kind}, lang string, text_hash bigint, symbols bigint, own double, key bigint, texts array<bigint>, times array<int>"
    scored = settle(texts.mapInArrow(_scored(*paths), schema), "scores")
    names = ["doc_id", "lang", "text_hash"]
    pieces = scored.where("key IS NULL").select("text_no", *names, "symbols", F.col("own").alias("adds"))
    met = scored.where("key IS NOT NULL").join(model.rest, "key").select(F.explode(F.arrays_zip("texts", "times")).alias("t"), "adds")
    more = met.select(F.col("t.texts").alias("text_no"), *[F.lit(None).cast(t).alias(c) for c, t in zip(names, (kind, "string", "bigint"))], F.lit(0).cast("long").alias("symbols"), (F.col("adds") * F.col("t.times")).alias("adds"))
    sums = pieces.unionByName(more).groupBy("text_no").agg(*[F.max(c).alias(c) for c in names], F.sum("symbols").alias("symbols"), F.sum("adds").alias("adds"))
    base = F.lit(None).cast("double")
    for name, value in model.base.items():
        base = F.when(scoring_model(F.col("text_hash"), model.base) == name, value).otherwise(base)
    out = settle(sums.select(*names, F.when(F.col("symbols") > 1, -(base + F.col("adds") / F.col("symbols"))).alias("log_perplexity")), "perplexity")
    forget(scored)
    return out
