"""WARC archives: written with an index, read back by the index first.

Every record is a gzip member of its own. Writing gives one index row per
record: archive, offset, length, URL, digest. Reading sorts the selected rows of
an archive by offset and coalesces neighbouring byte ranges into one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.kernel import small_batches
from quillspark.session import shared_dir, stored

INDEX = "page_id long, archive string, offset long, length long, url string, digest string"
#: Unselected bytes between two records that are read along rather than skipped.
GAP = 64 << 10
#: Bytes of an archive that one task reads.
SLICE = 8 << 20
DATE = "2000-01-01T00:00:00Z"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head alone."""
    clean = " ".join(url.split())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` without a payload: of equal payloads of ``least`` bytes or more the smallest page is first."""
    ids = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    firsts = ids.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    joined = ids.join(firsts, "digest", "left").where((F.col("size") >= least) & (F.col("first") != F.col("page_id")))
    return joined.select("page_id", F.col("first").alias("refers_to")).distinct()


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, url, html``) to archives in the shared folder; the index comes back.

    A null html counts as empty, a null url as blank. Each task writes under a
    name of its own attempt, so a repeated task leaves a file that no index row
    names. Repeated rows are records of their own; a null page_id is a response.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # written first, so that Catalyst knows their size: few of them go to every task, and no html is shuffled
    revisits = stored(roles(rows, least).select(F.col("page_id").alias("page"), F.lit(0).alias("part"), "refers_to"), "warc-revisits")
    part = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url", "html"), F.lit(1024)).cast("int")).otherwise(0)  # null page_ids don't meet in one task
    dealt = rows.join(revisits, (rows["page_id"] == revisits["page"]) & (part == revisits["part"]), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        at, out = 0, None
        try:
            for batch in batches:
                columns: tuple[list, ...] = ([], [], [], [], [], [])
                for page, url, html, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                    payload = (html.as_py() or "").encode()
                    digest = base32(hashlib.sha1(payload).hexdigest())
                    member = record(page.as_py(), url.as_py() or "", payload, digest, first.as_py())
                    if out is None:
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member)
                    for column, value in zip(columns, (page.as_py(), name, at, len(member), url.as_py(), digest), strict=True):
                        column.append(value)
                    at += len(member)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["page_id", "archive", "offset", "length", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    index = stored(dealt.mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("archive", F.concat(F.lit(f"{folder}/"), "archive"))


def read(index: DataFrame, gap: int = GAP) -> DataFrame:
    """The records that ``index`` selects: ``page_id, payload_bytes, payload_digest, record_type, refers_to, body_ok``.

    An archive's rows stay in reads of at most about 8 MB; ``body_ok`` says
    that a response's body has the digest and length of its headers. Null page_ids and repeated rows come back as they were
    written, an empty payload has 0 bytes; an empty selection gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 0)), strict=True))
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            k = 0
            while k < len(rows):
                archive, lo = rows[k][:2]
                end, stop = lo + rows[k][2], k + 1
                while stop < len(rows) and rows[stop][0] == archive and rows[stop][1] <= end + gap and rows[stop][1] + rows[stop][2] - lo <= 8 << 20:
                    end = rows[stop][1] + rows[stop][2]
                    stop += 1
                store, path = pafs.FileSystem.from_uri(archive)
                with store.open_input_file(path) as f:
                    data = f.read_at(end - lo, lo)
                for _, at, size, page in rows[k:stop]:
                    fields, http, body = parse(data[at - lo : at - lo + size])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(http["Content-Length"])
                    good = kind == "revisit" or (len(body) == length and base32(hashlib.sha1(body).hexdigest()) == digest)
                    first = int(fields["X-Refers-To-Page"]) if kind == "revisit" else None
                    for column, value in zip(columns, (page, length, digest, kind, first, good), strict=True):
                        column.append(value)
                k = stop
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "body_ok"])

    chosen = index.select("page_id", "archive", "offset", "length")
    ranged = chosen.withColumn("slice", F.floor(F.col("offset") / SLICE))
    # rows of the index are small, what they stand for is not: tasks follow the bytes to read
    parts = max(1, -(-int(chosen.agg(F.sum("length").alias("n")).first().n or 0) // SLICE))
    return ranged.repartition(parts, "archive", "slice").sortWithinPartitions("archive", "offset").drop("slice").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, body_ok boolean"
    )
