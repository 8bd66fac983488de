"""WARC archives: one gzip member per record, written by the tasks and read back one record at a time.

Each task writes archives of its own below a shared folder, under a name that depends on the task's number
alone, first beside the final name and then moved, so a task that runs again leaves the same file. The reader
never holds more than one record: it inflates a member step by step, parses the header when its blank line has
come, takes as many bytes as Content-Length says, and checks the digest of what it took.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import broadcast_if_small, spare, written

#: Payloads of fewer bytes are never written as a revisit.
LEAST_REVISIT = 100
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 16
_READ = "archive string, position bigint, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


class ArchiveError(ValueError):
    """An archive that does not follow its own framing or digests."""


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _number(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record as one gzip member. A revisit has no block; its header keeps the payload's size."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        head += [f"WARC-Block-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8"]
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}", f"X-Payload-Length: {size}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(head).encode() + b"\r\n\r\n") + made.compress(payload) + made.compress(b"\r\n\r\n") + made.flush()


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row and return archive, records, bytes: a row per archive.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least 100 bytes the one
    with the smallest id is the response and the others revisit it; rows that repeat that id are responses too,
    as is every record with a null id. A null url has no header. An empty table gives no archive. ``folder``
    must be new, and on storage that all executors reach.
    """
    data, digest, size, first = (spare(pages, c) for c in ("_data", "_digest", "_size", "_first"))
    name = F.col(f"`{id_col}`").cast("long")
    body = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    own = pages.select(name.alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias(data)).withColumns({digest: F.sha2(data, 256), size: F.octet_length(data).cast("long")})
    groups = own.filter(F.col(size) >= LEAST_REVISIT).groupBy(digest).agg(F.min("page_id").alias(first), F.count("*").alias("n"))
    shared = written(groups.filter(F.col("n") > 1).select(digest, first))
    marked = own.join(broadcast_if_small(shared, 120), digest, "left")
    refers = F.when(F.col(first) < F.col("page_id"), F.col(first))
    rows = marked.select("page_id", "url", F.when(refers.isNull(), F.col(data)).alias("data"), digest, size, refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, records, held = None, 0, 0

        def close() -> None:
            out.close()
            system.move(side, final)
            done.append((f"{folder}/{final.rsplit('/', 1)[1]}", records, held))

        side = final = ""
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            for page, url, sha, n, back, payload in zip(*columns, batch.column(2)):
                if out is None:
                    final = f"{root}/part-{context.partitionId():05d}-{len(done):04d}.warc.gz"
                    side = f"{root}/.attempt-{context.taskAttemptId()}-{len(done)}"
                    out, records, held = system.open_output_stream(side, compression=None), 0, 0
                made = record(page, url, payload.as_py() or b"", sha, n, back)
                out.write(made)
                records, held = records + 1, held + len(made)
                if held >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return written(rows.mapInArrow(write, "archive string, records bigint, bytes bigint"))


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header (names in lower case) and block of each record, in order."""
    pending, position = b"", 0
    while True:
        if not pending:
            pending = stream.read(_STEP)
            if not pending:
                return
        member, text, head, want = zlib.decompressobj(31), bytearray(), None, 0
        try:
            while not member.eof:
                if not pending:
                    pending = stream.read(_STEP)
                    if not pending:
                        raise ArchiveError(f"record {position} is cut off")
                text += member.decompress(pending)
                pending = b"" if not member.eof else member.unused_data
                if head is None and (at := text.find(b"\r\n\r\n")) >= 0:
                    lines = bytes(text[:at]).decode().split("\r\n")
                    if not lines[0].startswith("WARC/1."):
                        raise ArchiveError(f"record {position} has no version line")
                    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                    want = int(head["content-length"])
                    del text[: at + 4]
        except zlib.error as error:
            raise ArchiveError(f"record {position}: {error}") from None
        if head is None or len(text) != want + 4 or text[want:] != b"\r\n\r\n":
            raise ArchiveError(f"record {position} does not have the length it states")
        block = bytes(text[:want])
        if (stated := head.get("warc-block-digest")) and stated != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ArchiveError(f"record {position} does not have the digest it states")
        yield head, block
        position += 1


def read_archives(spark: SparkSession, archives: DataFrame, payload: bool = True) -> DataFrame:
    """archive, position, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for
    revisits, or if not asked for) of all records of the archives in column ``archive``. A damaged archive is an
    error. Bytes and digest are those of the full payload, counted from the block of a response and taken from
    the header of a revisit."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _file_system(path)
                rows, held = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for i, (head, block) in enumerate(read_records(stream)):
                        back = head.get("warc-refers-to")
                        if back is None:
                            size, digest = len(block), hashlib.sha256(block).hexdigest()
                            if head["warc-payload-digest"] != f"sha256:{digest}":
                                raise ArchiveError(f"{path}: record {i} does not have the digest it states")
                        else:
                            size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                        rows.append((path, i, _number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], None if back is None else _number(back), size, digest, block if payload and back is None else None))
                        held += len(block) if payload else 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    spread = archives.select("archive").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive")
    return spread.mapInArrow(read, _READ)
