"""WARC archives through a chunked record table.

A payload crosses every step as rows (record, chunk number, bytes): the JVM cuts it, the writer appends the rows to its
archive as they come, with a running SHA-256 that must end in the record's digest, and the reader yields the same rows from the
archive, each with the SHA-256 of the payload up to it. So memory is bounded by the chunk size and the batch, not by the record.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest id is written as response and
the others as revisit records that name its digest and id. Only ids and digests are joined to find them: each revisit becomes a row
of its own that is sorted before the chunks of its record, (id, digest) being a record's key.

Archives are gzipped record by record, as is usual, lie in the folder that the session names in spark.checkpoint.dir, and are opened
through pyarrow's file systems (local, HDFS, object stores). A task writes under a temporary name and renames at its end, so a task that is run
again replaces its own archive with an equal one.

Defined cases: null payload is empty; equal payloads under 100 bytes are all responses; rows that repeat an id are
all written, each judged by its own payload, as responses if the id is the smallest of that payload; a null id comes before all others; an empty table writes no archive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import NO_ID, beside, own_folder, table, unkeyed

CHUNK = 1 << 18
MIN_REVISIT = 100
BLOCK = 1 << 16  # read from an archive at once
ROWS_PER_ARCHIVE = 50_000
GZIP = 31  # zlib's window bits for gzip members

_CHUNKS = (
    ("id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()),
    ("bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()), ("declared", pa.string()), ("length", pa.int64()),
)
CHUNK_TABLE = "id long, record_type string, refers_to long, chunk int, data binary, bytes long, digest string, last boolean, declared string, length long"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """id, url, length, digest and the payload (data) of each row."""
    data = F.coalesce(pages[payload].cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.coalesce(pages[key].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"),
        F.octet_length(data).cast("long").alias("length"), F.sha2(data, 256).alias("digest"), data.alias("data"),
    )


def revisits(rows: DataFrame) -> DataFrame:
    """(id, digest, refers_to) of the records that repeat the payload of a smaller id. No payload takes part; the records of one
    digest are dealt over salts."""
    seen = rows.where(F.col("length") >= MIN_REVISIT).select("digest", "id")
    return beside(seen, ["digest"], "id", first=F.min("id")).where("id <> first").select("id", "digest", F.col("first").alias("refers_to")).distinct()


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a chunk of payload; an empty record has one row without bytes. ``row`` parts equal records."""
    n = F.greatest(F.ceil(F.octet_length("data") / chunk), F.lit(1)).cast("int")
    cut = rows.select("id", "digest", F.monotonically_increasing_id().alias("row"), "url", "length", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return cut.withColumn("data", F.substring("data", F.col("chunk") * chunk + 1, F.lit(chunk))).withColumn("refers_to", F.lit(None).cast("long"))


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Writes the archives into ``folder``; (archive, records) of each."""
    uri = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, out, member, n = f"{name}.{uuid.uuid4().hex}.tmp", None, None, 0
        refers, of = None, None  # what the next records of one id and digest refer to
        running, declared = None, None

        def close() -> None:
            if running is not None and running.hexdigest() != declared:
                raise ValueError("a record's chunks don't give its digest")
            if member:
                out.write(member.compress(b"\r\n\r\n") + member.flush())

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("id", "url", "length", "digest", "refers_to", "chunk")]
            for key, url, length, digest, refers_to, k, data in zip(*cols, batch.column("data")):
                if k < 0:  # comes before the records that it is about
                    refers, of = refers_to, (key, digest)
                    continue
                known = refers if of == (key, digest) else None
                if out is None:
                    out = fs.open_output_stream(draft, compression=None)
                if k == 0:
                    close()
                    member, n = zlib.compressobj(1, zlib.DEFLATED, GZIP), n + 1
                    running, declared = None if known is not None else hashlib.sha256(), digest
                    out.write(member.compress(_head(key, url, length, digest, known)))
                if running is not None:
                    part = data.as_buffer()
                    running.update(part)
                    out.write(member.compress(part))
        if out is not None:
            close()
            out.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])

    parts = max(1, -(-pages.count() // ROWS_PER_ARCHIVE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    all_ = records(pages)
    none = {"row": F.lit(-1).cast("long"), "url": F.lit(""), "length": F.lit(0).cast("long"), "chunk": F.lit(-1), "data": F.lit(b"")}
    rows = chunks(all_, chunk).unionByName(revisits(all_).withColumns(none)).repartition(parts, "id", "digest").sortWithinPartitions("id", "digest", "row", "chunk")
    return table(spark, rows.mapInArrow(write, "archive string, records long"), "archives")


def _head(key: int, url: str, length: int, digest: str, refers: int | None) -> bytes:
    kind, size = ("response", length) if refers is None else ("revisit", 0)
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:record:{key}>"), ("WARC-Target-URI", url.translate({10: "%0A", 13: "%0D"})), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(length)),
    ]
    if refers is not None:
        fields += [("WARC-Refers-To", f"<urn:record:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(size)))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


class _Stream:
    """Lines and byte counts from a file of gzip members, in blocks."""

    def __init__(self, file):
        self.file, self.held, self.raw, self.member = file, b"", b"", zlib.decompressobj(GZIP)

    def _more(self) -> bool:
        if not self.raw and not self.member.unconsumed_tail:
            self.raw = self.file.read(BLOCK)
            if not self.raw:
                return False
        self.held += self.member.decompress(self.member.unconsumed_tail or self.raw, BLOCK)
        self.raw = b""
        if self.member.eof:
            self.raw, self.member = self.member.unused_data, zlib.decompressobj(GZIP)
        return True

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:at], self.held[at + 2 :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("the archive ends inside a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


def read_records(file, chunk: int = CHUNK, keep: bool = True) -> Iterator[tuple]:
    """The chunk rows of one archive; ``keep`` False leaves the bytes out once they are digested."""
    stream = _Stream(file)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = {}
        while field := stream.line():
            name, _, value = field.decode().partition(": ")
            head[name.lower()] = value
        key = int(head["warc-record-id"][12:-1])
        refers = int(head["warc-refers-to"][12:-1]) if "warc-refers-to" in head else None
        size, digest = int(head["content-length"]), hashlib.sha256()
        for k in range(max(1, -(-size // chunk))):
            data = stream.take(min(chunk, size - k * chunk))
            digest.update(data)
            done = min(size, (k + 1) * chunk)
            yield key, head["warc-type"], refers, k, data if keep else None, done, digest.hexdigest(), done == size, head["warc-payload-digest"].removeprefix("sha256:"), int(head["warc-payload-length"])


def read_archives(archives: DataFrame, folder: str, chunk: int = CHUNK, keep: bool = True) -> DataFrame:
    """The chunk table of the archives named in ``archives``."""
    uri = _uri(folder)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                held, out = 0, []
                with fs.open_input_stream(name, compression=None) as file:
                    for row in read_records(file, chunk, keep):
                        out.append(row)
                        held += len(row[4] or b"") + 200
                        if held > 1 << 22:
                            yield _batch(out)
                            held, out = 0, []
                yield _batch(out)

    spread = archives.repartition(max(1, archives.count()), "archive")
    return spread.mapInArrow(rows, CHUNK_TABLE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(_CHUNKS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _CHUNKS)], names=[c for c, _ in _CHUNKS])


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives written for
    ``pages``. The digest of a response is taken from its bytes, that of a revisit from its header; a response whose bytes
    don't give the digest in its header raises."""
    folder = own_folder(spark, "warc")
    archives = write_archives(spark, pages, folder)
    last = read_archives(archives, folder, keep=False).where("last")
    sound = (F.col("record_type") == "revisit") | ((F.col("digest") == F.col("declared")) & (F.col("bytes") == F.col("length")))
    digest = F.when(F.col("record_type") == "revisit", F.col("declared")).when(sound, F.col("digest")).otherwise(F.raise_error(F.lit("payload and digest differ")).cast("string"))
    return last.select(
        unkeyed().alias("page_id"), F.col("length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", unkeyed("refers_to").alias("refers_to")
    )
