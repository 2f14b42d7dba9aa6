"""WARC archives: write pages with revisits for repeated payloads, read them back with segment reassembly.

A record's block is an HTTP response in chunked transfer framing. Blocks over ``SEGMENT_BYTES`` are split: the first
segment is the response record, the others are continuation records that name it as their origin, and may end up in any
file. The reader gathers continuations by origin, orders them by segment number, checks the total length and the
payload digest, and undoes the chunked framing. Files are written and read by Spark, so any store it knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, remove, shared_dir, table

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 8_192
#: Records in a file; bounds the bytes that one reader holds.
FILE_RECORDS = 2_000
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORD = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0" + END


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{row}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the line ends that close it; the writer adds those."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records_of(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, first: tuple[int | None, int] | None) -> Iterator[bytes]:
    """A page's records: a revisit if ``first`` names another record, else the response in as many segments as it takes."""
    own = record_id(page_id, row)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Page-ID", page_id)]
    http = ("Content-Type", "application/http; msgtype=response")
    if first is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", record_id(*first)), ("WARC-Profile", REVISIT_PROFILE), http], HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield _record([("WARC-Type", "response"), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), http], block)
        return
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    yield _record([("WARC-Type", "response"), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Segment-Number", 1), http], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{own}/{k}')}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part)


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per page as gzipped archives under ``path``.

    Null html counts as empty. Of pages with equal payloads of at least ``min_revisit_bytes`` that with the smallest id
    is the response and the others are revisits; smaller payloads are all responses. Of repeated rows with one id the
    first read is the response. A null id comes after all others; other columns are ignored. Payloads are equal if
    length and SHA-256 are. The rows are written with their digests first, and joined with the groups of several alone,
    so a payload that very many pages share is no hot key of a shuffle of pages.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("row", F.monotonically_increasing_id())
    raw = F.encode("html", "UTF-8")
    rows = table(rows.withColumns({"size": F.octet_length(raw), "sha": F.sha1(raw), "same": F.unhex(F.sha2(raw, 256))}))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    several = rows.filter(F.col("size") >= min_revisit_bytes).groupBy("same", "size").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = table(several.select("same", "size", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")))
    again = F.coalesce(F.col("row") != F.col("first_row"), F.lit(False))
    joined = rows.join(first, ["same", "size"], "left").select("page_id", "row", "url", F.when(~again, F.col("html")).alias("html"), "sha", "first_id", "first_row", again.alias("again"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                out: list[bytes] = []
                for r in batch.slice(start, 500).to_pylist():
                    payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                    digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                    out += records_of(r["page_id"], r["row"], r["url"], payload, digest, (r["first_id"], r["first_row"]) if r["again"] else None)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = joined.mapInArrow(archive, "record binary").select(F.col("record").cast("string"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    discard(rows, first)


def parse_warc(chunks: Iterator[bytes]) -> Iterator[dict]:
    """Records of a WARC stream given in pieces: header fields in lower case, and the block."""
    held, done = bytearray(), False

    def more() -> bool:
        nonlocal done
        piece = next(chunks, None)
        done = piece is None
        held.extend(piece or b"")
        return not done

    while True:
        while (end := held.find(END)) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends inside a record")
            return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + len(END) + int(fields["content-length"])
        while len(held) < stop + len(END) and more():
            pass
        if held[stop : stop + len(END)] != END:
            raise ValueError("a record does not end where its length says")
        fields["block"] = bytes(held[end + len(END) : stop])
        del held[: stop + len(END)]
        yield fields


def unzipped(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members, or of a plain file."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    while data:
        member = zlib.decompressobj(31)
        rest = data
        while rest and not member.eof:
            yield member.decompress(rest, step)
            rest = member.unconsumed_tail
        data = member.unused_data


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, segments apart."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for f in parse_warc(unzipped(batch.column(0)[k].as_py())):
                    digest = f.get("warc-payload-digest", "")
                    rows.append((_number(f.get("page-id")), f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f.get("warc-refers-to"), digest.removeprefix("sha1:") or None, _number(f.get("warc-segment-number")), f.get("warc-segment-origin-id"), _number(f.get("warc-segment-total-length")), f["block"]))
                    held += len(f["block"])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD.types)], schema=RECORD)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD.types)], schema=RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "page_id long, record_id string, record_type string, target string, refers string, digest string, segment int, origin string, total long, block binary")


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per response or revisit: page_id, record_id, record_type, target, payload_bytes, payload_digest, refers_to, payload.

    ``refers_to`` is the page id of the response that a revisit refers to, whose payload size it also has; the payload
    of a revisit is null, as is every payload unless ``keep_payload``. Raises on a wrong length, digest or framing, and
    on missing segments.
    """
    out = "page_id long, record_id string, target string, payload_bytes long, payload_digest string, payload binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["segment"])
                if len(parts) > 1 or parts[0]["segment"] > 0:
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                        raise ValueError(f"segments of {r['origin']} are missing or repeated")
                    if sum(len(p["block"]) for p in parts) != parts[-1]["total"]:
                        raise ValueError(f"the segments of {r['origin']} do not have their total length")
                payload = payload_of(b"".join(p["block"] for p in parts))
                if (digest := base32_sha1(payload)) != r["digest"]:
                    raise ValueError(f"the payload of {r['origin']} does not have its digest")
                rows.append((r["page_id"], r["origin"], r["target"], len(payload), digest, payload if keep_payload else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))], names=["page_id", "record_id", "target", "payload_bytes", "payload_digest", "payload"])

    raw = table(raw_records(spark, path))
    part = F.struct(F.coalesce("segment", F.lit(0)).alias("segment"), "total", "block")
    fields = ["page_id", "target", "digest"]
    whole = raw.filter("record_type = 'response' and segment is null").select(F.col("record_id").alias("origin"), *fields, F.array(part).alias("parts"))
    split = (
        raw.filter("segment is not null")
        .groupBy(F.coalesce("origin", "record_id").alias("origin"))
        .agg(*(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in fields), F.collect_list(part).alias("parts"))
    )
    responses = whole.unionByName(split).mapInArrow(decode, out).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    responses = responses if keep_payload else table(responses)
    first = responses.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes")
    revisits = raw.filter("record_type = 'revisit'").select("page_id", "record_id", "target", "refers", F.col("digest").alias("payload_digest"), F.lit(None).cast("binary").alias("payload"), "record_type").join(first, "refers", "left").drop("refers")
    return responses.unionByName(revisits)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_revisit_bytes)
    found = read_warc(spark, path, keep_payload=False)
    remove(spark, path)  # its records are in tables by now
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
