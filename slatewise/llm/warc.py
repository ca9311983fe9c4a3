"""WARC archives of page captures: written by Spark's text sink, read back and assembled to transactions."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep, shared_dir

#: Payloads from this size on are stored once.
MIN_REVISIT_BYTES = 100
#: Captures of one archive file, at three records each. Archives are read as streams, so this bounds the work of a task, not its memory.
CAPTURES_PER_FILE = 1000
#: So many repeated digests, of about 100 bytes each, are broadcast at most.
SENT_DIGESTS = 200_000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

RECORDS = (
    "archive string, record_id string, warc_type string, concurrent_to string, refers_to_record string, target_uri string, "
    "page_id long, payload_bytes long, payload_digest string, truncated_digest string, block string, place long"
)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    s = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), s(1, 8), F.lit("-"), s(9, 4), F.lit("-"), s(13, 4), F.lit("-"), s(17, 4), F.lit("-"), s(21, 12), F.lit(">"))


def _record(kind: str, record_id: Column, headers: list[Column], block: Column) -> Column:
    """One record without the two line ends that close it; absent headers are null."""
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"),
        *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return F.concat(head, F.lit(END), block)


def first_payloads(pages: DataFrame) -> DataFrame:
    """For each digest of a payload of MIN_REVISIT_BYTES or more that several rows have: its smallest page_id."""
    d = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    d = d.where(F.octet_length("body") >= MIN_REVISIT_BYTES).select("page_id", F.sha2("body", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies")).where("copies > 1 and first_page is not null").drop("copies")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a request, a response or revisit and a metadata record for each row of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8, empty for null. Of equal payloads of MIN_REVISIT_BYTES or more, rows
    with the smallest page_id are responses and the others revisits of it; a null page_id never is the
    smallest and revisits where another row can be referred to. Line ends in urls become spaces (headers
    are lines). Archives are gzip files of at most CAPTURES_PER_FILE captures."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.encode(html, "UTF-8")
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("uri"), html.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    firsts = keep(first_payloads(pages), "warc-firsts")
    if firsts.count() <= SENT_DIGESTS:  # else a shuffled join, whose large partitions Spark splits
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, "digest", "left").withColumn("seq", F.monotonically_increasing_id())
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    request_id = _uuid(F.lit("request"), F.col("seq").cast("string"))
    response_id = lambda p: _uuid(F.lit("response"), p, F.col("digest"))
    own_id = F.when(revisit, _uuid(F.lit("revisit"), F.col("seq").cast("string"))).otherwise(F.when(F.col("page_id").isNull(), _uuid(F.lit("unnamed"), F.col("seq").cast("string"))).otherwise(response_id(page)))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.col("uri"))
    of_page = F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), F.col("request_id"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    rows = rows.withColumns({"request_id": request_id, "own_id": own_id})
    request = _record("request", F.col("request_id"), [uri, of_page, F.lit("Content-Type: application/http;msgtype=request")], F.concat(F.lit("GET / HTTP/1.1\r\nUser-Agent: slatewise"), F.lit(END)))
    response = _record("response", F.col("own_id"), [uri, of_page, concurrent, digest, F.lit("Content-Type: application/http;msgtype=response")], F.concat(http, F.col("html")))
    again = _record(
        "revisit", F.col("own_id"),
        [uri, of_page, concurrent, digest, F.concat(F.lit("WARC-Refers-To: "), response_id(F.col("first_page").cast("string"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit("Content-Type: application/http;msgtype=response")],
        http,
    )
    about = _record("metadata", _uuid(F.lit("metadata"), F.col("seq").cast("string")), [uri, of_page, concurrent, F.lit("Content-Type: application/warc-fields")], F.concat(F.lit("payload-bytes: "), F.col("bytes")))
    records = rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), about)).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", 3 * CAPTURES_PER_FILE).text(path)


_FIELDS = re.compile(rb"\r\n([^:\r\n]+): ?([^\r\n]*)")


def parse_archive(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of one uncompressed archive that comes in chunks."""
    held, pos, gone, chunks = b"", 0, 0, iter(chunks)

    def more(size: int) -> bool:
        """Drop what is read and hold at least ``size`` bytes; False where the archive ends before."""
        nonlocal held, pos, gone
        parts, have = [held[pos:]], len(held) - pos
        while have < size and (chunk := next(chunks, None)) is not None:
            parts.append(chunk)
            have += len(chunk)
        gone, pos, held = gone + pos, 0, b"".join(parts)
        return have >= size

    while True:
        while (head := held.find(b"\r\n\r\n", pos)) < 0 and more(len(held) - pos + 1):
            pass
        if head < 0:
            if held[pos:].strip():
                raise ValueError(f"an archive ends inside a record at {gone + pos}")
            return
        if not held.startswith(b"WARC/", pos):
            raise ValueError(f"no record begins at {gone + pos}")
        fields = {k.decode().lower(): v.decode() for k, v in _FIELDS.findall(held, pos, head)}
        start, whole = head + 4 - pos, head + 4 - pos + int(fields["content-length"]) + 4
        if len(held) - pos < whole and not more(whole):
            raise ValueError(f"an archive ends inside a record at {gone + pos}")
        yield gone + pos, fields, held[pos + start : pos + whole - 4]
        pos += whole


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes]]:
    """(file, name, bytes) of each run of lines of one file in a batch; ``name`` stands at lines that can begin a record."""
    for batch in batches:
        files = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start < end:
                yield int(files[start]), batch.column(1)[start].as_py(), b"\n".join(batch.column(2).slice(start, end - start).to_pylist()) + b"\n"


def read_records(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """One row for each WARC record under ``path``; payload size and digest are computed from the block.

    ``block`` is the HTTP payload as text where ``with_block`` asks for it, else null. A revisit's block
    has no payload: its size is the one its HTTP header tells and its digest the one its header names.
    Archives are gzip files (Spark cuts plain ones): they come through the text source line by line, each in one task and in order, and records
    are put together from the lines. A task holds one record and one batch, whatever the size of an archive, which may pass 2 GB. A line's only
    separator is the line feed, so joining lines gives back every byte. An empty archive has no records; one that ends inside a record is an error."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        """(path, chunks) of each archive: runs of equal ``file``, across batches."""
        runs = _runs(batches)
        held = next(runs, None)
        while held is not None:
            at, name = held[0], held[1]

            def chunks() -> Iterator[bytes]:
                nonlocal held
                while held is not None and held[0] == at:
                    yield held[2]
                    held = next(runs, None)

            own = chunks()
            yield name, own
            for _ in own:  # what a reader left
                pass

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "place") else pa.string()) for n in names])
        rows: list[dict] = []
        size = 0
        for archive, content in archives(batches):
            for place, f, block in parse_archive(content):
                kind, row = f["warc-type"], {"archive": archive, "place": place}
                row |= {"record_id": f["warc-record-id"], "warc_type": kind, "concurrent_to": f.get("warc-concurrent-to"), "refers_to_record": f.get("warc-refers-to"), "target_uri": f.get("warc-target-uri")}
                row["page_id"] = int(f["x-page-id"]) if f.get("x-page-id") else None
                if kind in ("response", "revisit"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    row["truncated_digest"] = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if kind == "response":
                        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "block": payload.decode("utf-8", "replace") if with_block else None}
                    else:
                        row |= {"payload_bytes": int(re.search(rb"(?i)content-length: *(\d+)", head)[1]), "payload_digest": row["truncated_digest"]}
                elif with_block:
                    row["block"] = block.decode("utf-8", "replace")
                rows.append(row)
                size += len(block) if with_block else 500
                if size > 8_000_000 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    name = F.col("_metadata.file_path")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.xxhash64(name).alias("file"), F.when(F.col("value").startswith("WARC/"), name).alias("name"), F.col("value").cast("binary").alias("line"))
    return in_arrow(lines, parse, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, response (or revisit) and metadata records.

    Records join through their concurrent-to identifiers: a record belongs to the capture whose anchor it
    names, or is the anchor itself. One shuffle co-groups the three sides, as a full outer join of the
    three would. A capture without one of them has a null there; of several requests or metadata records
    that which comes first in (archive, place) stands; several responses give a row each."""
    anchor = F.coalesce("concurrent_to", "record_id")
    kept = F.struct("archive", "place", "record_id", "warc_type", "refers_to_record", "target_uri", "page_id", "payload_bytes", "payload_digest", "block")
    side = lambda *kinds: F.when(F.col("warc_type").isin(*kinds), kept)
    grouped = records.groupBy(anchor.alias("capture")).agg(
        F.min(side("request")).alias("request"), F.sort_array(F.collect_list(side("response", "revisit"))).alias("responses"), F.min(side("metadata")).alias("metadata")
    )
    return grouped.select("capture", "request", F.explode_outer("responses").alias("response"), "metadata")


def captures(pages: DataFrame, path: str | None = None, with_block: bool = False) -> DataFrame:
    """Write ``pages`` to archives under ``path`` (a new shared folder by default), read them back and assemble them.
    An empty table gives no archives with records and no rows."""
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return transactions(read_records(spark, f"{path}/*.gz", with_block))


def page_records(pages: DataFrame) -> DataFrame:
    """The contract's row per page from the assembled captures: a revisit's refers_to is the page of the
    response record that it names (joined by record id)."""
    done = captures(pages).select(F.col("response.*"))
    heads = done.where("warc_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("refers_to"))
    named = done.join(heads, "refers_to_record", "left")
    return named.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
