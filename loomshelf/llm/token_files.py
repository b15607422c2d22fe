"""Token ids in Arrow files of equal-length sequences and masks, in the order of ids, with an index of documents.

A dataset is a folder of shards and an index. A shard is an Arrow IPC file with two columns of fixed-size
lists: ``tokens`` (unsigned 16 or 32 bits, by the size of the vocabulary) and ``mask`` (true: a token, false:
padding after the last one of the shard). Documents run on across sequences. Both columns are plain buffers,
so a mapped file gives any sequence without a copy; every batch but the last has the same number of rows.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.llm.common import new_path, settle, whole_text

VOCABULARY = "byte_bpe_50k.json"
END = 2
LENGTH, BATCH_ROWS = 2048, 64
#: Ids after which a task goes on in another shard.
SHARD_IDS = 1 << 28
#: Characters that the tokenizer takes at once: it holds much more than the ids meanwhile.
CHARS_AT_ONCE = 500_000
#: Bounds of the piece memo: entries, and the longest piece that is kept.
MEMO_PIECES, MEMO_CHARS = 400_000, 40
# ids travel as text: a NULL would turn a pandas column of longs into floats
_INDEX = "shard bigint, path string, doc_id string, at bigint, n_tokens bigint"
_READ = "doc_id string, shard bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


@dataclass(frozen=True)
class Layout:
    length: int = LENGTH
    batch_rows: int = BATCH_ROWS
    wide: bool = False  # 32-bit ids

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u4" if self.wide else "<u2")

    @property
    def schema(self) -> pa.Schema:
        kind = pa.uint32() if self.wide else pa.uint16()
        return pa.schema([("tokens", pa.list_(kind, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])


class ShardWriter:
    """Gathers ids and writes full batches; at the end pads the last sequence. Memory: one batch."""

    def __init__(self, folder: str, layout: Layout):
        self.files, path = fs.FileSystem.from_uri(folder)
        self.files.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.arrow"  # of its own for each attempt; only the index makes it count
        self.uri, self.layout, self.at = f"{folder}/{name}", layout, 0
        self.sink = self.files.open_output_stream(f"{path}/{name}")
        self.writer = pa.ipc.new_file(self.sink, layout.schema)
        self.room = layout.length * layout.batch_rows
        self.held = np.zeros(self.room, layout.dtype)
        self.used = 0

    def add(self, ids: np.ndarray) -> int:
        """Append ids; the place of the first one in the shard."""
        at, done = self.at, 0
        while done < len(ids):
            n = min(self.room - self.used, len(ids) - done)
            self.held[self.used : self.used + n] = ids[done : done + n]
            self.used += n
            done += n
            if self.used == self.room:
                self._flush()
        self.at += len(ids)
        return at

    def _flush(self) -> None:
        rows = -(-self.used // self.layout.length)
        size = rows * self.layout.length
        tokens, mask = self.held[:size].copy(), np.arange(size) < self.used
        tokens[self.used :] = 0
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.layout.length) for x in (tokens, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.layout.schema))
        self.used = 0

    def close(self) -> None:
        if self.used:
            self._flush()
        self.writer.close()
        self.sink.close()


class ShardReader:
    """Random access to a shard; mapped, not read, where the file is local."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("tokens").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _batch(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.last = (k, self.reader.get_batch(k).column("tokens").flatten().to_numpy(zero_copy_only=True))
        return self.last[1]

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch = self.reader.get_batch(row // self.rows)
        return tuple(batch.column(c)[row % self.rows].values.to_numpy(zero_copy_only=False) for c in ("tokens", "mask"))

    def span(self, at: int, n: int) -> np.ndarray:
        size, parts = self.rows * self.length, []
        while n > 0:
            k, start = divmod(at, size)
            piece = self._batch(k)[start : start + n]
            parts.append(piece)
            at, n = at + len(piece), n - len(piece)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.last = (-1, np.zeros(0))
        self.source.close()


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[str, ...]:
    """What the library cuts out of a text before anything else."""
    return tuple(token.content for token in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def _memo(path: str, dtype: str) -> dict[str, bytes]:
    """Ids of the pieces this worker has met."""
    return {}


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of a pattern. In ASCII texts its classes are plain ranges, which the faster ``re`` can serve."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    every = regex.compile(pattern).findall
    if r"\p" in plain:
        return every
    ascii_only = re.compile(plain, re.ASCII).findall
    return lambda text: ascii_only(text) if text.isascii() else every(text)


#: Characters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STANDS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


def _encoded(texts: list[str], path: str, dtype: np.dtype, pattern: str) -> Iterator[np.ndarray]:
    """Ids of each text. The vocabulary's pre-tokenizer cuts a text into the matches of the pattern and
    merges never cross them, so the tokenizer's model is asked once for each piece. Texts that hold an added
    token go through the tokenizer whole."""
    model, memo, split, added = tokenizer(path).model, _memo(path, dtype.str), splitter(pattern), added_tokens(path)
    code = {2: "H", 4: "I"}[dtype.itemsize]
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held < CHARS_AT_ONCE and i + 1 < len(texts):
            continue
        whole = {k: tokenizer(path).encode(x, add_special_tokens=False).ids for k, x in enumerate(texts[start : i + 1]) if any(a in x for a in added)}
        pieces = [() if k in whole else split(x) for k, x in enumerate(texts[start : i + 1])]
        new = set(chain.from_iterable(pieces)).difference(memo)
        if len(memo) + len(new) > MEMO_PIECES:
            memo.clear()
            new = set(chain.from_iterable(pieces))
        for piece in new:
            coded = piece.encode("utf-8").decode("latin-1").translate(_STANDS)
            memo[piece] = array(code, [token.id for token in model.tokenize(coded)]).tobytes()
        for k, own in enumerate(pieces):
            yield np.array(whole[k], dtype) if k in whole else np.frombuffer(b"".join([memo[x] for x in own]), dtype)
        for piece in new:
            if len(piece) > MEMO_CHARS:
                del memo[piece]
        start, held = i + 1, 0


def write_tokens(
    docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, path: str | None = None, pattern: str | None = None, layout: Layout = Layout()
) -> DataFrame:
    """Encode the documents, end each with the id ``end``, and write shards in ascending id order; the index.

    The texts are dealt out by ranges of the id, so a shard holds a range and the shards follow each other by
    number. Index columns: ``shard``, ``path``, ``doc_id``, ``at`` (place in the shard), ``n_tokens``. It is
    committed by Spark, and shards are named anew by each attempt, so a lost executor leaves unlisted files at
    most.

    A text is cut as the tokenizer as loaded cuts it, the strings of its added tokens included. NULL and empty texts
    give the end id alone; a long text runs on over as many sequences as it needs. NULL ids come first; rows that repeat an id follow each other
    by their text. An empty table gives an empty index. Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder, path = folder or new_path(spark, "tokens"), path or public_tokenizers.path(VOCABULARY)
    pattern = pattern or public_tokenizers.PATTERN
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(docs, text_col).alias("text"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = np.array([end], layout.dtype)
        writer, shard = None, TaskContext.get().partitionId() << 32  # the shards of a task follow each other
        for part in parts:
            if writer and writer.at >= SHARD_IDS:
                writer.close()
                writer, shard = None, shard + 1
            writer = writer or ShardWriter(folder, layout)
            found = []
            for ids in _encoded(part["text"].tolist(), path, layout.dtype, pattern):
                found.append((writer.add(ids), len(ids) + 1))
                writer.add(last)
            out = pd.DataFrame(found, columns=["at", "n_tokens"])
            yield out.assign(shard=shard, path=writer.uri, doc_id=part["doc_id"].to_numpy())[["shard", "path", "doc_id", "at", "n_tokens"]]
        if writer:
            writer.close()

    dealt = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    index = dealt.select(F.col("doc_id").cast("string"), "text").mapInPandas(write, _INDEX)
    return settle(index.withColumn("doc_id", F.col("doc_id").cast("bigint")), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Read the shards back by their index: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``.

    The checksum is that of the document's ids as little-endian unsigned 32-bit integers. A row for each row of
    the index, repeats and NULL ids too; an empty index gives none. Other columns of the index are not read.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, opened = None, None
        for part in parts:
            sums = []
            for uri, at, n in zip(part["path"], part["at"], part["n_tokens"]):
                if uri != opened:
                    if reader:
                        reader.close()
                    reader, opened = ShardReader(uri), uri
                sums.append(zlib.crc32(reader.span(at, n).astype("<u4").tobytes()))
            yield part[["doc_id", "shard", "at", "n_tokens"]].assign(ids_crc32=np.array(sums, np.int64))

    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    # the index lies in the order of its shards: each task reads the files its rows name
    found = index.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, _READ)
    return found.join(bases, "shard").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
