"""Byte-level BPE by automaton matching and backtracking, and the way back from ids to bytes.

Every token that ends in a text is found in one pass of an Aho-Corasick automaton (bytes mapped to Latin-1
characters). The encoder takes the longest token at each place and steps back to shorter ones when the token
does not fit its left neighbour. Whether two tokens may stand side by side depends on those two alone: undoing
their merges in the order of rank must never show a pair that would have merged across the border first. The
answers are memoised, and a place once given up is not tried again, so the time is linear in the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of the piece memo: entries, and the longest piece that is kept.
MEMO_PIECES, MEMO_CHARS = 120_000, 40
MEMO_PAIRS = 200_000


class ByteBpe:
    """Encoder and decoder for a rank file: one line per token, base64 bytes and rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        self.memo: dict[str, bytes] = {}

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """The automaton and the tables of the encoder; a worker that only decodes never builds them."""
        self.length = {rank: len(token) for token, rank in self.ranks.items()}
        # the two tokens whose merge made each token; a byte is its own halves and older than any merge
        self.halves: dict[int, tuple[int, int]] = {}
        matcher = ahocorasick.Automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
            elif len(parts := self._merge(token, rank)) == 2:
                self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
            else:
                continue  # merges never lead to it; only a whole piece can be this token
            matcher.add_word(token.decode("latin-1"), rank)
        matcher.make_automaton()
        self.age = {rank: rank if len(self.tokens[rank]) > 1 else -1 for rank in self.halves}
        # the longest token that properly begins each token
        self.shorter: dict[int, int | None] = {}
        for rank in self.halves:
            begins = [r for end, r in matcher.iter(self.tokens[rank].decode("latin-1")) if end + 1 == self.length[r] and r != rank]
            self.shorter[rank] = begins[-1] if begins else None
        self.fits: dict[tuple[int, int], bool] = {}
        return matcher

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """What merges of a rank under ``below`` make of the bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether the encoder may leave these two tokens next to each other."""
        limit = None
        while True:
            joint = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joint is not None and (limit is None or joint < limit):
                return False
            old, new = self.age[left], self.age[right]
            if old < 0 and new < 0:
                return True
            # undo the later merge; of equal ones the right, since equal merges run from the left
            if old > new:
                limit, left = old, self.halves[left][1]
            else:
                limit, right = new + 1, self.halves[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        matcher = self.matcher
        length, fits, shorter = self.length, self.fits, self.shorter
        longest = [0] * len(piece)
        for end, rank in matcher.iter(piece.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank
        n = len(piece)
        usable = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else None
        while at < n:
            end = at + length[token]
            if usable[end]:
                ok = True
                if out:
                    pair = (out[-1], token)
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= MEMO_PAIRS:
                            fits.clear()
                        ok = fits[pair] = self._side_by_side(*pair)
                if ok:
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token is None:  # nothing fits here: give the place up and shorten the token before it
                usable[at] = 0
                before = out.pop()
                at -= length[before]
                token = shorter[before]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for piece in self.pattern.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode("utf-8")), "<u4").tobytes()
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One tokenizer per worker, vocabulary and pattern."""
    return ByteBpe(path, pattern)


def encode(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Ids of a text column as little-endian unsigned 32-bit integers; an empty or NULL text has none."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    @F.arrow_udf("binary")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for part in texts:
            yield pa.array((bpe.encode(t.as_py()) for t in part), pa.binary())

    return run(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Bytes of a column of ids as ``encode`` gives them; NULL ids give no bytes."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for part in parts:
            yield pa.array((bpe.decode(i.as_py()) for i in part), pa.binary())

    return run(F.coalesce(ids, F.lit(b"")))


def round_trip(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """``token_ids`` as ``encode`` and ``decoded`` as ``decode`` give them, by one worker with one set of tables."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    @F.arrow_udf("struct<token_ids: binary, decoded: binary>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for part in texts:
            ids = pa.array((bpe.encode(t.as_py()) for t in part), pa.binary())
            back = pa.array((bpe.decode(i.as_py()) for i in ids), pa.binary())
            yield pa.StructArray.from_arrays([ids, back], ["token_ids", "decoded"])

    return run(F.coalesce(text.cast("string"), F.lit("")))


def encode_documents(docs: DataFrame, text_col: str = "text", out_col: str = "token_ids", **vocabulary: str) -> DataFrame:
    """The documents with a column of ids (binary, see ``encode``) in place of any column of that name.

    Each match of the pattern is encoded by itself, without special tokens. NULL and empty texts have no ids;
    rows and other columns stay as they are; an empty table stays empty.
    """
    return docs.withColumn(out_col, encode(docs[text_col], **vocabulary))
