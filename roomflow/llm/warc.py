"""WARC archives through a chunked record table.

A payload is a sequence of rows ``(record, chunk_no, data)`` of at most
``chunk_bytes`` bytes; a task sees a payload chunk by chunk and carries only its
running SHA-256, so no step after the input row holds a whole payload. The chunk
table is written once and read by three steps: payload digests (the running
digest of the last chunk), the choice of responses and revisits, and the
archive records.

Writing: a payload of one chunk is one ``response`` record; a longer one is
segmented as the WARC standard provides (``response`` with
``WARC-Segment-Number: 1``, then ``continuation`` records), so its segments may
be in any file and order. Of records with equal payloads of at least
``min_revisit`` bytes the smallest key is the response, the others are
``revisit`` records without payload. The text writer puts the bytes out
unchanged, each record ended by two line ends, in gzip files.

Reading: the text reader hands out the bytes up to each newline; a small state
machine per file follows the declared lengths, so payloads may hold anything,
WARC headers included. Segments of one payload are sorted by number and hashed
in order. Uncompressed archives are read when a file is one split; a file split
in its middle raises an error (compress it), as its framing is unknown there.

Defined results: a null payload is empty; empty payloads and those under
``min_revisit`` bytes are all responses; a null key sorts first and is written
without a key field; repeated rows are records of their own (one of them is the
response); ties of the key are broken by a written row number; an empty table
gives an empty archive and table; other columns are ignored, and a null or
missing url leaves its header out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KeyFilter, map_arrow, materialize, new_path

CHUNK = 64 * 1024  # bytes of a chunk row; 10,000 rows of an Arrow batch stay under 1 GB
MIN_REVISIT = 100
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMITTED = 4 << 20  # bytes of data in an emitted batch


def _running_digests(position: int, column: int, data: int):
    """Adds the SHA-256 and length of the payload up to and including each row;
    rows of a record follow each other, ``position`` being 0 at its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, size, record = hashlib.sha256(), 0, None
        for b in batches:
            ids, numbers = b.column(column).to_pylist(), b.column(position).to_pylist()
            digests, sizes = [], []
            for k, (one, n) in enumerate(zip(ids, numbers)):
                if one != record or n == 0:
                    h, size, record = hashlib.sha256(), 0, one
                piece = b.column(data)[k].as_buffer()
                h.update(piece)
                size += len(piece)
                digests.append(h.hexdigest())
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(digests, pa.string()), pa.array(sizes, pa.int64())],
                names=[*b.schema.names, "sha256", "upto"])

    return run


def chunk_table(records: DataFrame, key_col: str, payload_col: str, url_col: str | None = None,
                chunk_bytes: int = CHUNK) -> DataFrame:
    """``record, key, url, n_chunks, chunk_no, data, sha256, upto``, written once.

    ``record`` numbers the rows of ``records``; ``sha256`` and ``upto`` are the
    digest and length of the payload up to the end of the chunk.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = records.select(
        F.monotonically_increasing_id().alias("record"), F.col(key_col).alias("key"),
        (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"), payload.alias("payload"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / F.lit(chunk_bytes))).cast("int")
    chunks = rows.withColumn("n_chunks", n).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no")).select(
        "record", "key", "url", "n_chunks", "chunk_no",
        F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))
    schema = T.StructType([*chunks.schema.fields, T.StructField("sha256", T.StringType()),
                           T.StructField("upto", T.LongType())])
    return materialize(map_arrow(chunks, _running_digests(4, 0, 5), schema), "warc-chunks")


def choose_records(chunks: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``record, digest, size, first_record, first_key``, a row per record;
    ``first_*`` names the response of a revisit and is null for a response."""
    whole = materialize(chunks.filter(F.col("chunk_no") == F.col("n_chunks") - 1).select(
        "record", "key", F.col("sha256").alias("digest"), F.col("upto").alias("size")), "warc-records")
    groups = materialize(
        whole.filter(F.col("size") >= min_revisit).groupBy("digest")
        .agg(F.min(F.struct("key", "record")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select(F.col("digest").alias("group"), "first"), "warc-groups")
    again = F.col("first.record") != F.col("record")
    return whole.join(groups, (whole["digest"] == groups["group"]) & (whole["size"] >= min_revisit), "left").select(
        "record", "digest", "size", F.when(again, F.col("first.record")).alias("first_record"),
        F.when(again, F.col("first.key").cast("string")).alias("first_key"))


def _urn(run: str, record: Column, chunk: Column) -> Column:
    """A record id that depends only on the run, the record and the chunk."""
    h = F.md5(F.concat_ws(":", F.lit(run), record.cast("string"), chunk.cast("string")))
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in at]), F.lit(">"))


def _safe(value: Column) -> Column:
    """A header value without line ends."""
    return F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _field(name: str, value: Column) -> Column:
    """``name: value``; null, hence left out by ``concat_ws``, where the value is."""
    return F.concat(F.lit(f"{name}: "), value)


def write_archive(records: DataFrame, path: str, key_col: str, payload_col: str,
                  url_col: str | None = None, date: str = "2026-01-01T00:00:00Z",
                  chunk_bytes: int = CHUNK, min_revisit: int = MIN_REVISIT) -> None:
    """Write a record (or its segments) per row as gzip files under ``path``."""
    chunks = chunk_table(records, key_col, payload_col, url_col, chunk_bytes)
    # A record of one chunk that is no revisit knows its digest and size: it is written where it is.
    decided = materialize(choose_records(chunks, min_revisit).filter(
        F.col("first_record").isNotNull() | (F.col("size") > chunk_bytes)), "warc-decided")
    known = KeyFilter(decided.select("record"), ["record"])
    moved = known.held(chunks).join(decided, "record", "left").filter(
        F.col("first_record").isNull() | (F.col("chunk_no") == 0))
    rows = moved.unionByName(known.absent(chunks), allowMissingColumns=True).withColumns({
        "digest": F.coalesce("digest", "sha256"), "size": F.coalesce("size", "upto")})
    run = uuid.uuid4().hex
    revisit, first = F.col("first_record").isNotNull(), F.col("chunk_no") == 0
    zero = F.lit(0)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(F.when(first, http).otherwise(F.lit("")).cast("binary"),
                    F.when(revisit, F.lit(b"")).otherwise(F.col("data")))
    rows = rows.withColumn("block", body)
    split = ~revisit & (F.col("n_chunks") > 1)
    head = F.concat_ws(
        "\r\n", F.lit(VERSION),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).when(first, F.lit("response"))
               .otherwise(F.lit("continuation"))),
        _field("WARC-Record-ID", _urn(run, F.col("record"), F.col("chunk_no"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", _safe(F.col("url"))),
        _field("X-Record-Key", F.when(first, _safe(F.col("key")))),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("digest")))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(revisit, _urn(run, F.col("first_record"), zero))),
        _field("X-Refers-To-Key", F.when(revisit, _safe(F.col("first_key")))),
        _field("WARC-Segment-Number", F.when(split, (F.col("chunk_no") + 1).cast("string"))),
        _field("WARC-Segment-Origin-ID", F.when(split & ~first, _urn(run, F.col("record"), zero))),
        _field("WARC-Segment-Total-Length", F.when(
            split & (F.col("chunk_no") == F.col("n_chunks") - 1),
            (F.col("size") + F.octet_length(http)).cast("string"))),
        _field("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _field("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"))
    out = rows.select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class _Framing:
    """Follows one archive file line by line and yields chunk rows."""

    def __init__(self, chunk_bytes: int, with_data: bool):
        self.limit, self.with_data = chunk_bytes, with_data
        self.head: dict[str, str] | None = None  # of the record being read
        self.lines: list[bytes] = []
        self.left = 0  # bytes of the block to come
        self.http = False  # inside the HTTP header of the block

    def _begin(self) -> None:
        names = [x.decode("utf-8", "replace").partition(":") for x in self.lines[1:]]
        self.head = {n.strip().lower(): v.strip() for n, _, v in names}
        self.lines, self.left = [], int(self.head.get("content-length", 0))
        self.http = (self.head.get("content-type", "").startswith("application/http")
                     and self.head.get("warc-type") != "continuation")
        self.entity: int | None = None
        self.hash, self.size, self.chunk, self.parts, self.held = hashlib.sha256(), 0, 0, [], 0

    def _row(self, last: bool) -> tuple:
        h, data = self.head, b"".join(self.parts)
        self.hash.update(data)
        self.size += len(data)
        digest = h.get("warc-payload-digest", "")
        row = (h.get("warc-record-id"), h.get("warc-segment-origin-id") or h.get("warc-record-id"),
               h.get("warc-type"), int(h.get("warc-segment-number", 0)), self.chunk, last,
               h.get("x-record-key"), h.get("x-refers-to-key"), h.get("warc-target-uri"),
               digest[7:].lower() if digest.lower().startswith("sha256:") else None,
               self.entity, data if self.with_data else b"", self.hash.hexdigest(), self.size)
        self.chunk, self.parts, self.held = self.chunk + 1, [], 0
        return row

    def line(self, line: bytes) -> Iterator[tuple]:
        """Takes a line without its newline."""
        if self.head is None:
            text = line.rstrip(b"\r")
            if text:
                self.lines.append(text)
            elif self.lines:
                if not self.lines[0].startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {self.lines[0][:60]!r}")
                self._begin()
                if self.left == 0:
                    yield self._row(True)
                    self.head = None
            return
        data = (line + b"\n")[:self.left]
        self.left -= len(data)
        if self.http:
            name, _, value = line.rstrip(b"\r").partition(b":")
            if name.lower() == b"content-length":
                self.entity = int(value)
            self.http = bool(name)
        else:
            for at in range(0, len(data), self.limit):
                piece = data[at:at + self.limit]
                if self.held + len(piece) > self.limit:
                    yield self._row(False)
                self.parts.append(piece)
                self.held += len(piece)
        if self.left == 0:
            yield self._row(True)
            self.head = None


_CHUNKS = pa.schema([
    ("record_id", pa.string()), ("origin_id", pa.string()), ("warc_type", pa.string()),
    ("segment", pa.int32()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("key", pa.string()),
    ("refers_to", pa.string()), ("url", pa.string()), ("declared_sha256", pa.string()),
    ("entity_bytes", pa.int64()), ("data", pa.binary()), ("sha256", pa.string()), ("upto", pa.int64())])
_CHUNKS_DDL = ("record_id string, origin_id string, warc_type string, segment int, chunk_no int, last boolean, "
               "key string, refers_to string, url string, declared_sha256 string, entity_bytes bigint, "
               "data binary, sha256 string, upto bigint")


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The records under ``path`` as chunk rows (HTTP headers taken off; ``sha256``
    and ``upto`` run within a segment). ``with_data=False`` leaves ``data`` empty."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, framing, rows, size = None, None, [], 0
        for b in batches:
            files, starts = b.column(1).to_pylist(), b.column(2).to_pylist()
            for k, line in enumerate(b.column(0).to_pylist()):
                if files[k] != file:
                    if framing and framing.head is not None:
                        raise ValueError(f"{file} ends inside a record")
                    file, framing = files[k], _Framing(chunk_bytes, with_data)
                if starts[k] > 0:
                    raise ValueError(f"{file} is read in several splits; compress it with gzip")
                for row in framing.line(line):
                    rows.append(row)
                    size += len(row[11]) + 500
                if size >= EMITTED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*rows), _CHUNKS.types)], schema=_CHUNKS)
                    rows, size = [], 0
        if framing and framing.head is not None:
            raise ValueError(f"{file} ends inside a record")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), _CHUNKS.types)], schema=_CHUNKS)

    return map_arrow(lines, run, _CHUNKS_DDL)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``key, url, warc_type, refers_to, payload_bytes, payload_digest,
    declared_sha256`` per record: length and digest are those of the payload read,
    over all its segments in order; a revisit has the declared ones."""
    columns = ["key", "url", "warc_type", "refers_to", "payload_bytes", "payload_digest", "declared_sha256"]
    whole = read_chunks(spark, path, with_data=False).filter(
        F.col("last") & (F.col("segment") == 0) & F.col("warc_type").isin("response", "resource", "revisit"))
    revisit = F.col("warc_type") == "revisit"
    single = whole.select(
        "key", "url", "warc_type", "refers_to",
        F.when(revisit, F.col("entity_bytes")).otherwise(F.col("upto")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_sha256")).otherwise(F.col("sha256")).alias("payload_digest"),
        "declared_sha256")
    parts = read_chunks(spark, path).filter(F.col("segment") > 0).select(
        "origin_id", (F.col("segment") - 1).alias("position"), "chunk_no", "last", "key", "url", "warc_type",
        "declared_sha256", "data")
    parts = parts.repartition("origin_id").sortWithinPartitions("origin_id", "position", "chunk_no")
    # A record starts where origin_id changes; position never resets it inside a record.
    schema = T.StructType([*parts.schema.fields, T.StructField("sha256", T.StringType()),
                           T.StructField("upto", T.LongType())])
    hashed = map_arrow(parts.withColumn("position", F.lit(1)), _running_digests(1, 0, 8), schema)
    segmented = hashed.groupBy("origin_id").agg(
        F.max("key").alias("key"), F.max("url").alias("url"), F.lit("response").alias("warc_type"),
        F.lit(None).cast("string").alias("refers_to"), F.max("upto").alias("payload_bytes"),
        F.max_by("sha256", F.struct("upto", "last")).alias("payload_digest"),
        F.max("declared_sha256").alias("declared_sha256"))
    return single.select(*columns).union(segmented.select(*columns))


def round_trip(records: DataFrame, key_col: str, payload_col: str, url_col: str | None = None,
               chunk_bytes: int = CHUNK) -> DataFrame:
    """Archive ``records`` in the shared folder and read the records back."""
    spark = records.sparkSession
    path = new_path(spark, "warc")
    write_archive(records, path, key_col, payload_col, url_col, chunk_bytes=chunk_bytes)
    return read_records(spark, path)
