"""WARC archives: one gzip member per record, written by Spark tasks and read back sequentially.

The writer marks records with equal payloads as revisits of the one with the largest id. The reader walks through an
archive with bounded memory: it inflates one member at a time, frames the record by its content length and checks
both digests.

Defined cases: a null payload is empty; a null url has no target header; a null page id is written as "none" and
read back as null; repeated rows with the largest id of their payload are all responses; a payload is held whole, one at
a time; columns other than page_id, url and html are neither read nor kept; a damaged record is reported in `error`, and
the rest of its archive is not read; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import Scratch, table

CRLF = b"\r\n"
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
#: Tasks that read archives, at most; beyond that a task reads several.
READERS = 20_000
RECORD_ID = "<urn:x-page:%s>"
RECORDS = "archive string, offset long, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, verified boolean, error string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- writing ---------------------------------------------------------------------------------------------------------


def plan_revisits(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to: null for responses, else the id of the response.

    Only digests that occur twice go into the join: few rows are broadcast by Spark itself, many are joined by a
    shuffle, in which a digest of a third of all rows is split (its side is a written table, so both sides are
    plain exchanges).
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("_sha", F.sha1("payload"))
    large = p.where(F.length("payload") >= min_bytes)
    twice = scratch.keep(large.groupBy("_sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_sha").alias("_key"), "_first"), "twice")
    p = p.join(twice, F.when(F.length("payload") >= min_bytes, F.col("_sha")) == F.col("_key"), "left")
    return p.select("page_id", "url", "payload", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"))


def arrow_uri(uri: str) -> str:
    """A URI as pyarrow names its file systems, from one as Hadoop does: s3a and s3n are s3, "file:/x" is "file:///x"."""
    return re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?!/)", "file:///", uri))


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def record_bytes(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One gzip member."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {RECORD_ID % ('none' if page_id is None else page_id)}",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {' '.join(url.split())}"]),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        *([] if refers_to is None else [f"WARC-Refers-To: {RECORD_ID % refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF) + z.flush()


def write_archives(planned: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of plan_revisits as archives below folder; one row an archive: archive, records, bytes.

    Names hold the task attempt, so a repeated task never touches a file of another; write the returned rows once, and
    they name the archives that count. folder: a URI that pyarrow's file systems can open on every executor.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        done, out, records, size = [], None, 0, 0

        def close():
            out.close()
            done.append((f"{folder}/{name}", records, size))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, records, size = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                member = record_bytes(*row, date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return planned.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "archive string, records long, bytes long")


# -- reading ---------------------------------------------------------------------------------------------------------


class Damaged(ValueError):
    """A record that breaks the format."""


def members(stream, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each gzip member, inflated piece by piece; Damaged at a cut or broken one."""
    offset, rest = 0, b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise Damaged(f"member at {offset} is cut off")
            try:
                parts.append(z.decompress(rest))
            except zlib.error as e:
                raise Damaged(f"member at {offset}: {e}") from e
            used += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield offset, b"".join(parts)
        offset += used


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with lower-case names, and the block that the content length frames."""
    head, found, body = data.partition(CRLF + CRLF)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise Damaged("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isdigit() or len(body) != int(length) + 4 or body[-4:] != CRLF + CRLF:
        raise Damaged("the content length doesn't frame the block")
    return headers, body[:-4]


def _page(record_id: str | None) -> int | None:
    inner = (record_id or "").strip("<>").rpartition(":")[2]
    return int(inner) if inner.lstrip("-").isdigit() else None


def read_record(headers: dict[str, str], block: bytes) -> dict:
    """Fields of RECORDS without archive and offset, and the payload (None for a revisit)."""
    http, _, payload = block.partition(CRLF + CRLF)
    revisit = headers.get("warc-type") == "revisit"
    length = next((int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:")), None)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    ok = headers.get("warc-block-digest", "").removeprefix("sha1:") == sha1_base32(block)
    if not revisit:
        ok = ok and len(payload) == length and sha1_base32(payload) == digest
    return {
        "page_id": _page(headers.get("warc-record-id")), "record_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"),
        "payload_bytes": length, "payload_digest": digest, "refers_to": _page(headers.get("warc-refers-to")), "verified": ok, "error": None,
        "payload": None if revisit else payload,
    }


def read_archives(archives: DataFrame, payloads: bool = False, batch_bytes: int = 4 << 20) -> DataFrame:
    """The records of the archives that the column `archive` names: RECORDS, and payload (binary) if asked for."""
    names = ["archive", "offset", "page_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "verified", "error"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    if payloads:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                system, path = open_folder(uri)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    try:
                        for offset, data in members(stream):
                            rows.append({"archive": uri, "offset": offset, **read_record(*parse_record(data))})
                            size += 200 + (len(data) if payloads else 0)
                            if size >= batch_bytes:
                                yield emit(rows)
                                rows, size = [], 0
                    except Damaged as e:
                        rows.append({"archive": uri, "error": str(e)})
                if rows:
                    yield emit(rows)

    return archives.select("archive").mapInArrow(read, RECORDS + ", payload binary" * payloads)


def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    scratch = Scratch(spark, "warc")
    planned = plan_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch)
    archives = scratch.keep(write_archives(planned, scratch.path("archives")), "manifest")
    # By ranges of names, so that no task is left without an archive while another has several.
    spread = archives.select("archive").repartitionByRange(min(READERS, max(1, archives.count())), "archive")
    return read_archives(spread).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", "error")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS first_id FROM p),
-- Base 32 of 20 bytes: eight groups of 5 bytes, eight digits each.
b AS (
  SELECT *, list_aggregate(list_transform(range(0, 4), lambda g: list_aggregate(list_transform(range(0, 8), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(sha, CAST(g * 10 + 1 AS BIGINT), 10))::BIGINT >> (35 - 5 * i)::BIGINT) & 31) + 1 AS BIGINT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM r)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
       TRUE AS verified, CAST(NULL AS VARCHAR) AS error
FROM b
"""

QUERIES = {"op2_warc_roundtrip": op2_warc_roundtrip}
ORACLE = {"op2_warc_roundtrip": OP2_SQL}
