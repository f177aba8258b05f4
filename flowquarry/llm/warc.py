"""WARC archives: writing with revisits and segments, and reading back by segment reassembly.

Writing gives each page one record, or, where its block is longer than a segment, a first record and continuation
records that name it as their origin. Blocks are HTTP responses in chunked transfer framing. Spark's text writer
puts the records out, so archives go to any store that Spark can write to.

Reading parses records by their lengths, groups continuations by origin identifier, orders them by segment number,
verifies that none is missing and that the total length is as declared, and decodes the chunked framing. A revisit
has no payload of its own: its length and digest are those of the response that it refers to, read back.

Defined cases: null and empty payloads are responses of zero bytes; payloads under the least size are all responses;
of equal payloads the smallest id is the response, and rows of one id with equal payloads are repeated responses;
rows with a null id are responses that none refers to; very long payloads are cut into segments, and are held whole one
at a time; an empty table gives an empty result; other columns are not read, so their names are free. A record whose
segments or length do not fit raises an error naming it, and so does a revisit whose response is not there.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, saved, shared_dir, unsaved

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
LEAST_REVISIT = 100
#: Records in an archive, at most, so that a reader can hold one whole: 512 segments are at most 16 MB.
RECORDS = 512
#: Revisits that are broadcast at most, at some 120 bytes each.
MOST_BROADCAST = 100_000
#: Bytes of records that a reader passes on at a time.
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, salt: str, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{salt}/{segment}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for i in range(0, len(payload), size) if (p := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    at, out = 0, []
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            break
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at : at + size])
        at += size + 2
    while (end := body.index(CRLF, at)) != at:  # trailer fields
        at = end + 2
    if at + 2 != len(body):
        raise ValueError("bytes after the last chunk")
    return b"".join(out)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]], b""]
    return CRLF.join(lines) + CRLF + block + CRLF + CRLF


def page_records(page_id: int | None, salt: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The record of one page, in segments if its block is long; a revisit has headers only."""
    own = record_id(page_id, salt)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", (re.sub(r"[\x00-\x20\x7f]", "", url) if url else "") or "urn:unknown")]
    common += [("X-Page-Id", "" if page_id is None else str(page_id))]
    digests = [("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *digests, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers_to))], b"")]
    block = HTTP_HEAD + chunked(payload)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(pieces) == 1:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *digests, kind], block)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *digests, kind, ("WARC-Segment-Number", "1")], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, salt, n)), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        if n == len(pieces):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(headers, piece))
    return out


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, least_revisit: int = LEAST_REVISIT) -> None:
    """Writes one record per page to archives under path."""
    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # The first page of each payload: pre-aggregated, so a payload on a third of the pages costs a row a task. Payloads
    # themselves are not moved to find it, and only go by (digest, page) where revisits are too many to broadcast.
    keys = saved(rows.where(F.octet_length("payload") >= least_revisit).groupBy("digest", "page_id").agg(F.lit(True).alias("known")), "digests")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    again = saved(keys.join(firsts, "digest").where("first_id < page_id").select("digest", "page_id", "first_id"), "revisits")
    decided = rows.join(F.broadcast(again) if again.count() <= MOST_BROADCAST else again, ["digest", "page_id"], "left")
    decided = decided.select("page_id", "url", "payload", "digest", F.col("first_id").alias("refers_to"))

    written = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A record's id is its own among all archives: this writing, the task's part of it, and a count.
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for row in range(batch.num_rows):  # one page at a time, as payloads may be long
                n += 1
                found = page_records(batch.column(0)[row].as_py(), f"{written}/{part}/{n}", *(c[row].as_py() for c in batch.columns[1:]), segment_bytes)
                # The text writer ends each row with a line feed, which is the record's last byte.
                yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in found], pa.binary())], ["record"])

    records = decided.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)
    unsaved(keys)
    unsaved(again)


def unzipped(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The contents of an archive, a piece of bounded length at a time, member after member where it is gzipped."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + size] for i in range(0, len(data), size))
        return
    while data:
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            piece = member.decompress(data, size)
            if not piece and not member.unconsumed_tail and not member.eof:
                raise ValueError("a gzip member is cut short")
            data = member.unconsumed_tail
            if piece:
                yield piece
        data = member.unused_data.lstrip(b"\0")


def parse(data: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of every record of an archive; what is held is a record and a piece."""
    pieces, held, at, done = iter([data] if isinstance(data, bytes) else data), bytearray(), 0, 0

    def more() -> bool:
        """Takes another piece in, and drops what was read."""
        nonlocal at, done
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        done, at = done + at, 0
        held.extend(piece)
        return True

    while True:
        while len(held) - at < 5 and more():
            pass
        if at == len(held):
            return
        if held[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {done + at}")
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError(f"record at byte {done + at} has no end of headers")
        lines = held[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size, begin = int(headers["content-length"]), end + 4 - at
        while len(held) - at < begin + size + 4 and more():
            pass
        block, closing = bytes(held[at + begin : at + begin + size]), held[at + begin + size : at + begin + size + 4]
        if len(block) != size or closing != b"\r\n\r\n":
            raise ValueError(f"record at byte {done + at} does not end where its length says")
        yield headers, block
        at += begin + size + 4


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, with chunked framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return dechunked(body)
    return body


RECORD = "record_id string, kind string, page_id long, digest string, refers_to long, origin string, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under path; origin is set for segments (a first segment is its own origin)."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                out, size = [], 0
                for h, block in parse(unzipped(value.as_py())):
                    own, segment = h["warc-record-id"], h.get("warc-segment-number")
                    number = lambda k, h=h: int(h[k]) if h.get(k) else None
                    origin = h.get("warc-segment-origin-id") or (own if segment else None)
                    out.append((own, h["warc-type"], number("x-page-id"), h.get("warc-payload-digest", "").removeprefix("sha256:") or None, number("x-refers-to-page-id"), origin, number("warc-segment-number"), number("warc-segment-total-length"), block))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _decoded(records: DataFrame) -> DataFrame:
    """(page_id, kind, refers_to, digest, payload_bytes, payload_digest) of whole records."""
    schema = "page_id long, kind string, refers_to long, digest string, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for kind, declared, blocks in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if kind == "revisit":
                    sizes.append(None)
                    digests.append(None)
                    continue
                payload = payload_of(b"".join(blocks.as_py()))
                found = hashlib.sha256(payload).hexdigest()
                if declared and declared != found:
                    raise ValueError(f"payload digest {found} is not the declared {declared}")
                sizes.append(len(payload))
                digests.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return records.select("page_id", "kind", "refers_to", "digest", "blocks").mapInArrow(run, schema)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records, their blocks as an array in order: those of one segment, and the others with all their segments."""
    whole = records.where("origin is null").select("page_id", "kind", "refers_to", "digest", F.array("block").alias("blocks"))
    parts = F.array_sort(F.collect_list(F.struct("segment", "total", "page_id", "kind", "refers_to", "digest", "block")))
    joined = records.where("origin is not null").groupBy("origin").agg(parts.alias("parts"))
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    complete = (F.size("parts") == last["segment"]) & (first["segment"] == 1) & (length == last["total"])
    checked = F.when(complete, F.transform("parts", lambda p: p["block"])).otherwise(F.raise_error(F.concat(F.lit("segments do not fit: "), F.col("origin"))))
    return whole.unionByName(joined.select(first["page_id"].alias("page_id"), first["kind"].alias("kind"), first["refers_to"].alias("refers_to"), first["digest"].alias("digest"), checked.alias("blocks")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page in the archives under path."""
    found = saved(_decoded(reassembled(read_records(spark, path))), "records")
    responses = found.where("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
    originals = responses.where("page_id is not null").groupBy(F.col("page_id").alias("at"), F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = found.where("kind = 'revisit'").select("page_id", "refers_to", "digest").join(originals, (F.col("refers_to") == F.col("at")) & (F.col("digest") == F.col("of")), "left")
    size = F.when(F.col("at").isNotNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response that the revisit refers to: page "), F.col("refers_to").cast("string"))))
    return responses.unionByName(revisits.select("page_id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to new archives in the shared folder, returns what is read back from them, and deletes them."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, **options)
    found = read_archives(spark, path)
    delete(spark, path)
    return found
