"""Web archives with a Zstandard dictionary: written record by record, revisits for repeated payloads, and read back."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshelf.llm.common import new_path, settle

#: Fixed values of the format: the skippable frame that holds the dictionary, and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Bytes of records a dictionary is built from, of the dictionary, and of raw records in one archive.
TRAIN_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 128 << 20
#: An archive of fewer bytes has no dictionary; with fewer records than this, records are cut into samples.
LEAST_BYTES, SAMPLES = 8 << 10, 64
_MANIFEST = "archive string, records bigint, raw_bytes bigint"
_RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else int(page_id)}>"


def _id(urn: str | None) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2] if urn else ""
    return int(tail) if tail else None


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record; a revisit has the HTTP head, with the full payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on the first ``TRAIN_BYTES`` of the records; None for less than ``LEAST_BYTES``.

    Where records are few and long, pieces of them are the samples.
    """
    samples, size = [], 0
    for item in records:
        samples.append(item[: TRAIN_BYTES - size])
        size += len(samples[-1])
        if size >= TRAIN_BYTES:
            break
    if size < LEAST_BYTES:
        return None
    if len(samples) < SAMPLES:
        piece = size // SAMPLES
        samples = [x[i : i + piece] for x in samples for i in range(0, len(x), piece)]
    wanted = min(DICTIONARY_BYTES, size // 8)
    while wanted >= 256:  # records much alike fill only a smaller one
        try:
            return zstandard.train_dictionary(wanted, samples)
        except zstandard.ZstdError:
            wanted //= 4
    # nothing repeats enough to be learned: the end of the samples serves as it is
    return zstandard.ZstdCompressionDict(b"".join(samples)[-min(DICTIONARY_BYTES, size // 8) :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Archives in a folder: the first records give the dictionary, then every record is a frame of its own."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.folder_uri = folder
        self.files.create_dir(self.folder, recursive=True)
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0
        self.out = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, item: bytes) -> None:
        if self.out is not None:
            self._write(item)
            return
        self.waiting.append(item)
        self.waiting_bytes += len(item)
        if self.waiting_bytes >= TRAIN_BYTES:
            self._open()

    def _open(self) -> None:
        self.name = f"part-{uuid.uuid4().hex}.warc.zst"  # of its own for each attempt; only the manifest makes it count
        self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)  # the frames are ours
        self.count = self.raw = 0
        words = _dictionary(self.waiting)
        if words is not None:
            data = words.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self.compress = zstandard.ZstdCompressor(level=6, dict_data=words, write_checksum=True).compress
        held, self.waiting, self.waiting_bytes = self.waiting, [], 0
        for item in held:
            self._write(item)

    def _write(self, item: bytes) -> None:
        if self.out is None:
            self.add(item)
            return
        self.out.write(self.compress(item))
        self.count += 1
        self.raw += len(item)
        if self.raw >= ARCHIVE_BYTES:
            self._close()

    def _close(self) -> None:
        self.out.close()
        self.out = None
        self.done.append((f"{self.folder_uri}/{self.name}", self.count, self.raw))

    def finish(self) -> list[tuple[str, int, int]]:
        while self.waiting:
            self._open()
        if self.out is not None:
            self._close()
        return self.done


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, one at a time."""
    head = stream.read(8)
    words = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        words = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0]))
        head = b""
    chained = io.BufferedReader(_Chained(head, stream), 1 << 20)
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(chained, read_across_frames=True), 1 << 20)
    while first := plain.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError("not the start of a record")
        headers = {}
        while line := plain.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = plain.read(int(headers["content-length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("record without its end")
        yield headers, block


class _Chained(io.RawIOBase):
    def __init__(self, first: bytes, rest):
        self.first, self.rest = first, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.first or self.rest.read(len(into))
        self.first = data[len(into) :]
        into[: min(len(data), len(into))] = data[: len(into)]
        return min(len(data), len(into))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write one record per page into dictionary-compressed archives; the manifest of the archives.

    Of pages with equal payloads of ``least_bytes`` or more, that with the largest id is the response and
    the others revisit it; smaller payloads are all responses. Who revisits whom is found on digests alone;
    payloads move once, by page. A NULL payload is empty, a NULL url is left out, NULL ids are written
    without a number and never are the largest. Rows that repeat an id and a payload share its type. An empty
    table gives no archive. Archives are named anew by each attempt and count only by the manifest, which
    Spark commits, so a lost executor leaves unlisted files at most. Every archive of ``LEAST_BYTES`` or more begins
    with its dictionary; a record is held whole, however long.

    ``folder`` must be one that all executors see; by default it lies in the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"))
    marks = settle(
        rows.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("n")).distinct(), "payload-digests"
    )
    first = marks.groupBy("digest").agg(F.max("page_id").alias("first"))
    revisits = (
        marks.join(first, "digest")
        .where((F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first")
    )
    own = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    typed = own.join(revisits, (own.digest == revisits._digest) & own.page_id.eqNullSafe(revisits._id), "left")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = ArchiveWriter(folder)
        for part in parts:
            for page_id, url, data, digest, revisit, to in part.itertuples(index=False):
                data = data if isinstance(data, bytes) else bytes(data)
                name = base64.b32encode(digest).decode()
                page = None if pd.isna(page_id) else page_id
                writer.add(record(page, url, data, name, None if pd.isna(to) else to, bool(revisit)))
        yield pd.DataFrame(writer.finish(), columns=["archive", "records", "raw_bytes"])

    # ids travel as text: a NULL would turn a pandas column of longs into floats
    out = typed.select(
        F.col("page_id").cast("string"), "url", "payload", "digest", F.col("_digest").isNotNull().alias("revisit"), F.col("first").cast("string")
    ).mapInPandas(write, _MANIFEST)
    return settle(out, "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives of a manifest, payloads included (NULL for revisits).

    Every archive is a task of its own. A row for each record, repeats too; empty payloads come back empty, long
    ones whole. An empty manifest gives no records; a damaged payload raises. Other columns are not read.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            return out.astype({"page_id": "Int64", "refers_to": "Int64"})

        for part in parts:
            for uri in part["archive"]:
                files, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_archive(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = headers["warc-type"] == "revisit"
                        told = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != told or digest_of(payload) != digest):
                            raise ValueError(f"{uri}: the payload of {headers['warc-record-id']} is damaged")
                        rows.append(
                            (
                                _id(headers["warc-record-id"]),
                                headers.get("warc-target-uri"),
                                told,
                                digest,
                                headers["warc-type"],
                                _id(headers.get("warc-refers-to")),
                                None if revisit else payload,
                            )
                        )
                        held += len(block)
                        if held > 4 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    # a number that adaptive execution keeps, and ranges, which give every name a task where hashes would collide
    n = max(1, manifest.count())
    return manifest.select("archive").repartitionByRange(n, "archive").mapInPandas(run, _RECORDS)
