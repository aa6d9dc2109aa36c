"""WARC writing, and reading by segment reassembly.

``write_warc`` writes a record per page. A block longer than ``segment_bytes`` is cut into a
first record and ``continuation`` records; the payload travels in chunked transfer framing.
``read_warc`` parses the archives by ``Content-Length``, groups the segments of a record by
their origin identifier, orders them by segment number, verifies the total length, and takes
the chunked framing off. Neither assumes that the segments of a record lie in one file.

Archives go through Spark's text writer, whose line separator is the end of a WARC record, so
any store that Spark can write works and a lost task is written again. A file holds at most
``records_per_file`` records of at most ``segment_bytes``, which bounds what a reading task
holds at once; a record is one page's, whatever the size of its group of copies.

Defined cases: null html is an empty payload; a null page_id or url leaves the header out and
is read as null; a page whose id is null is a response, and others revisit the smallest
id that isn't null; rows that repeat the smallest id of a payload are all responses; control
characters in a url are percent-encoded; in archives of others, each record may be a gzip member of its own or none, a
header that names no page is null, and a cut file is an error; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.session import scratch_path

from .common import clashless, small_batches, table

END = "\r\n\r\n"
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
RECORDS_PER_FILE = 2000
#: Bytes that are unpacked at once, and bytes of blocks in a frame of records.
PIECE, FRAME_BYTES = 1 << 16, 1 << 24


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Chunked framing off; an error if it is cut short or malformed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at:at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END.encode() + block


def page_records(page_id, url, html: bytes | None, sha1: str, n_bytes: int, refers_to,
                 segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page; html is None for a revisit."""
    rid = f"<urn:uuid:{uuid.uuid4()}>"
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    page = None if page_id is None else f"<urn:page:{page_id}>"
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("X-Page-ID", page),
              ("WARC-Payload-Digest", f"sha1:{base32_sha1(sha1)}")]
    if html is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common,
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", f"<urn:page:{refers_to}>")], block)
        return
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
             + chunked(html, chunk_bytes))
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common,
                   ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                       ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k),
                       ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
               chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files into the folder ``path``.

    Of pages with equal payloads of at least ``min_bytes``, the one with the smallest page_id is
    a response and the others revisit it. A group of copies is reduced to its smallest id before
    the shuffle; a hot digest in the join back is split by adaptive execution.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = clashless(pages, ["page_id", "url", "html"]).select(
        "page_id", "url", payload.alias("html"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n_bytes"))
    first = (own.filter((F.col("n_bytes") >= min_bytes) & F.col("page_id").isNotNull())
             .groupBy(F.col("sha1").alias("f_sha1")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    revisits = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False)) & (F.col("n_bytes") >= min_bytes)
    dealt = own.join(first, F.col("sha1") == F.col("f_sha1"), "left").select(
        "page_id", "url", F.when(~revisits, F.col("html")).alias("html"), "sha1", "n_bytes",
        F.when(revisits, F.col("first_id")).alias("refers_to"))

    def records(frames):
        for f in frames:
            out = []
            for p, u, h, s, n, r in zip(f.page_id, f.url, f.html, f.sha1, f.n_bytes, f.refers_to, strict=True):
                out.extend(page_records(None if pd.isna(p) else int(p), u, h, s, int(n), None if pd.isna(r) else int(r),
                                        segment_bytes, chunk_bytes))
            yield pd.DataFrame({"record": out})

    # page ids stay exact: as text through pandas, where a null would turn longs into doubles
    ids = dealt.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    (ids.mapInPandas(records, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def unzipped(data: bytes) -> Iterator[bytes]:
    """What an archive holds, piece by piece: of one gzip member after the other, or as it is if it isn't compressed."""
    view, at = memoryview(data), 0
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i:i + PIECE]) for i in range(0, len(view), PIECE))
        return
    while at < len(view):
        if not any(view[at:at + 1]):  # members may be padded with zeros
            at += 1
            continue
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            piece = view[at:at + PIECE]
            out = member.decompress(piece)
            at += len(piece) - len(member.unused_data)
            if out:
                yield out


def _head(lines: list[str]) -> dict:
    """Headers with lower-case names; a line that begins with a blank goes on with the one before."""
    out: list[list[str]] = []
    for x in lines:
        if x[:1] in " \t" and out:
            out[-1][1] += " " + x.strip()
        else:
            name, _, value = x.partition(":")
            out.append([name.strip().lower(), value.strip()])
    return dict(out)


def parse_records(data: bytes | Iterator[bytes]) -> Iterator[dict]:
    """The records of an archive, given whole or in pieces: its headers with lower-case names, and ``block``. No more than a
    record and a piece is held. What isn't a whole record is an error."""
    pieces, held, at = iter([data] if isinstance(data, bytes) else data), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        seen = 0
        while (end := held.find(END.encode(), max(0, seen - len(END)))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise ValueError(f"the record at byte {at} is cut short")
                return
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = _head(lines[1:])
        begin = end + len(END)
        stop = begin + int(head["content-length"])
        while len(held) < stop + len(END) and more():
            pass
        if held[stop:stop + len(END)] != END.encode():
            raise ValueError(f"the record at byte {at} isn't as long as it says")
        yield head | {"block": bytes(held[begin:stop])}
        del held[:stop + len(END)]
        at += stop + len(END)


RECORDS = ("warc_type string, record_id string, url string, page_id long, payload_digest string, refers_to long, "
           "origin_id string, segment_number int, total_length long, block binary")


def _page_number(head: dict, key: str) -> int | None:
    """The page that a header names, null if it names something else."""
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", head.get(key, ""))
    return int(m[1]) if m else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per WARC record of the ``.gz`` and ``.warc`` files in ``path``, as they lie there. A task holds a file as it is
    stored, a record, and a frame of records."""
    import pyarrow as pa

    def parsed(files):
        names = [f.strip().split(" ")[0] for f in RECORDS.split(",")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(),
                 pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

        for batch in files:
            for content in batch.column("content"):
                rows, size = [], 0
                for h in parse_records(unzipped(content.as_py())):
                    rows.append((h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), _page_number(h, "x-page-id"),
                                 h.get("warc-payload-digest", "").removeprefix("sha1:") or None, _page_number(h, "warc-refers-to"),
                                 h.get("warc-segment-origin-id"), int(h["warc-segment-number"]) if "warc-segment-number" in h else None,
                                 int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, h["block"]))
                    size += len(h["block"])
                    if size > FRAME_BYTES:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    # a task gets files of spark.sql.files.maxPartitionBytes together, at most
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return files.mapInArrow(parsed, RECORDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per response or revisit: page_id, url, payload (null for a revisit), payload_bytes,
    payload_digest, record_type, refers_to, n_segments, verified.

    ``verified``: for a response, that the segments are numbered without a gap, that their
    lengths add up to the stated total, that the framing decodes, and that the payload has the
    digest of the header; for a revisit, that its target is stated. A record that can't be put
    together keeps its row, with a null payload and verified = false.
    """
    records = read_records(spark, path).filter(F.col("warc_type").isin("response", "revisit", "continuation", "resource"))
    whole = records.filter("segment_number IS NULL").withColumns({"n_segments": F.lit(1), "sound": F.lit(True)})
    parts = records.filter("segment_number IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    # the segments of one record: one page's payload, so the group is as large as its result
    joined = (parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment_number", "block"))).alias("s"), F.max("total_length").alias("total_length"),
        *[F.max(F.when(F.col("segment_number") == 1, F.col(c))).alias(c)
          for c in ("warc_type", "record_id", "url", "page_id", "payload_digest", "refers_to")])
        .withColumn("block", F.expr("cast(array_join(transform(s, x -> cast(x.block as string)), '') as binary)"))
        .withColumn("n_segments", F.size("s"))
        .withColumn("sound", F.expr("transform(s, x -> x.segment_number) = sequence(1, size(s)) "
                                    "AND octet_length(block) <=> total_length AND record_id IS NOT NULL")))
    cols = ["warc_type", "url", "page_id", "payload_digest", "refers_to", "block", "n_segments", "sound"]

    def payload(kind: str, block: bytes) -> tuple[bytes | None, int | None]:
        head, _, body = block.partition(END.encode())
        if kind == "revisit":
            m = re.search(rb"(?i)\r\nContent-Length: *([0-9]+)", head)
            return None, int(m[1]) if m else None
        try:
            body = dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding: *chunked", head) else body
        except ValueError:
            return None, None
        return body, len(body)

    def decoded(frames):
        for f in frames:
            got = [payload(k, b) if ok else (None, None) for k, b, ok in zip(f.warc_type, f.block, f.sound, strict=True)]
            digests = [None if p is None else base64.b32encode(hashlib.sha1(p).digest()).decode() for p, _ in got]
            f["payload"] = [p for p, _ in got]
            f["payload_bytes"] = pd.array([n for _, n in got], dtype="Int64")
            f["verified"] = [ok and (r is not None if k == "revisit" else d is not None and d == want) for ok, k, r, d, want
                             in zip(f.sound, f.warc_type, f.refers_to, digests, f.payload_digest, strict=True)]
            yield f.rename(columns={"warc_type": "record_type"})[
                ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments", "verified"]]

    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    out = whole.select(*cols).unionByName(joined.select(*cols)).withColumns(ids).mapInPandas(
        decoded, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, "
                 "record_type string, refers_to string, n_segments int, verified boolean")
    return out.withColumns({c: F.col(c).cast("long") for c in ids})


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as WARC and read back."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


_DIGITS = ", ".join(f"'{i:x}'" for i in range(16))
_BITS = ", ".join(f"'{i:04b}'" for i in range(16))
OP10_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first_id FROM p),
d AS (SELECT *, list_aggregate(list_transform(string_split(s, ''),
         lambda x: list_extract([{_BITS}], list_position([{_DIGITS}], x))), 'string_agg', '') AS bits FROM f)
SELECT page_id, octet_length(b) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) = '1'
              THEN CAST(pow(2, 4 - j) AS BIGINT) ELSE 0 END))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS verified
FROM d
"""
