"""WARC archives under Zstandard: a writer and a validating reader.

Layout of a file: one skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame per record, each followed
by an empty skippable frame, which decoders ignore. A partition makes files of about ARCHIVE_BYTES (one longer record may pass
that), each with a dictionary trained on a bounded sample of its own records. Files are written by Spark's text sink, so they
reach any file system that Spark can write, and a lost task leaves nothing behind.

The reader loads whole files, which are bounded, takes the dictionary from the leading frame, decodes one frame per record (frame
by frame, so any bytes may stand in a payload), and validates: version line, required headers, Content-Length against the block,
payload digests, and that nothing is left over. A fault raises with the file and the record's number.

Pages with equal payloads (equal SHA-1 and length) share one stored payload: the largest page id is the response, others
are revisit records that refer to it. Only ids, addresses and digests are shuffled to find them; payloads stay where they are read, but
for the few that a bitmap of the revisits' ids takes for one. Payloads under `min_revisit_bytes` are always responses. Null html is an empty
payload, a null url gets a urn, a null page id is always a response and sorts below all others. Repeated rows of the largest id
are responses each (with one record id). Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.shared import cut, fresh_path, lookup, marked, narrowed

#: Magic numbers of the dictionary's frame and of other skippable frames, little-endian.
DICTIONARY_MAGIC = struct.pack("<I", 0x184D2A5D)
SKIP_MAGICS = {struct.pack("<I", 0x184D2A50 + i) for i in range(16)}
FRAME_MAGIC = struct.pack("<I", 0xFD2FB528)
#: Parts the text sink's lines: an empty skippable frame.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
#: Records and bytes of a partition that its dictionary is trained on, and the dictionary's size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 20, 1 << 14
LEVEL = 3
#: Bytes of frames after which a new archive begins.
ARCHIVE_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{digest}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None, length: int | None = None) -> bytes:
    """One WARC record. A revisit keeps the digest and the length of the payload (given, or the payload's), not the payload."""
    digest = digest or base32(hashlib.sha1(payload).digest())
    length = len(payload) if length is None else length
    target = url.replace("\r", "%0D").replace("\n", "%0A") if url else f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id(page_id, digest)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 8 else None
    except zstandard.ZstdError:  # too few or too equal samples for training
        trained = None
    raw = trained.as_bytes() if trained else b""
    return DICTIONARY_MAGIC + struct.pack("<I", len(raw)) + raw, trained


def archives(records: Iterator[bytes], most: int | None = None) -> Iterator[bytes]:
    """Whole archives: the dictionary's frame, then a frame per record and an empty frame after each."""
    held: list[bytes] = []
    size = 0
    compress = None
    out: list[bytes] = []

    def begin() -> None:
        nonlocal compress
        lead, trained = dictionary_frame([r[:16384] for r in held])
        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **({"dict_data": trained} if trained else {})).compress
        out.append(lead)
        for r in held:
            out.extend((EMPTY_FRAME, compress(r)))

    for r in records:
        if compress is None:
            held.append(r)
            size += len(r)
            if len(held) < SAMPLE_RECORDS and size < SAMPLE_BYTES:
                continue
            begin()
            size = sum(map(len, out))
        else:
            out.extend((EMPTY_FRAME, compress(r)))
            size += len(out[-1]) + len(EMPTY_FRAME)
        if size >= (most or ARCHIVE_BYTES):
            yield b"".join(out)
            held, size, compress, out = [], 0, None, []
    if compress is None and held:
        begin()
    if out:
        yield b"".join(out)


def write(pages: DataFrame, path: str) -> None:
    """(page_id, url, html, refers_to[, sha1, bytes]) to archives in a folder; revisits may come without html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                page, url, html, refers, sha1, length = batch.columns
                for i, u, h, to, s, n in zip(page.to_pylist(), url.to_pylist(), html, refers.to_pylist(), sha1.to_pylist(), length.to_pylist(), strict=True):
                    given = to is not None and s is not None
                    yield record(i, u, h.as_py() or b"", to, base32(bytes.fromhex(s)) if given else None, n if given else None)

        for archive in archives(records()):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    have = pages.columns
    more = [F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("sha1", "string"), ("bytes", "long"))]
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary"), F.col("refers_to").cast("long"), *more)
    # the sink copies bytes as they are; a row is an archive and a file, its line mark an empty frame
    files = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    files.write.option("lineSep", EMPTY_FRAME.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def read_file(data: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of one archive, validated."""
    size, n = len(data), 0
    if not size:
        return
    view = memoryview(data)
    if bytes(view[:4]) != DICTIONARY_MAGIC or size < 8:
        raise WarcError(f"{name}: no dictionary frame at the start")
    at = 8 + struct.unpack("<I", view[4:8])[0]
    if at > size:
        raise WarcError(f"{name}: the dictionary is cut off")
    raw = bytes(view[8:at])
    if raw[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    while at < size:
        magic = bytes(view[at : at + 4])
        if magic in SKIP_MAGICS:
            if size < at + 8 or size < (at := at + 8 + struct.unpack("<I", view[at + 4 : at + 8])[0]):
                raise WarcError(f"{name}: a skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"{name}: record {n}: not a frame")
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            if at >= size:
                raise WarcError(f"{name}: record {n}: the frame is cut off")
            step = view[at : at + (1 << 16)]
            try:
                parts.append(one.decompress(step))
            except zstandard.ZstdError as e:
                raise WarcError(f"{name}: record {n}: {e}") from e
            at += len(step) - len(one.unused_data)
        yield parsed(b"".join(parts), f"{name}: record {n}")
        n += 1


#: Fixed: the header fields that every record has.
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def parsed(raw: bytes, name: str) -> tuple[dict[str, str], bytes]:
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"{name}: no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise WarcError(f"{name}: bad header line {line[:80]!r}")
        fields[key.decode().strip().lower()] = value.decode().strip()
    if missing := [k for k in REQUIRED if k not in fields]:
        raise WarcError(f"{name}: no {missing[0]}")
    length = fields["content-length"]
    if not length.isdecimal() or rest[int(length) :] != b"\r\n\r\n":
        raise WarcError(f"{name}: Content-Length {length} does not fit the block")
    block = rest[: int(length)]
    if (d := fields.get("warc-block-digest")) and d != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise WarcError(f"{name}: the block's digest differs")
    return fields, block


def page_of(urn: str) -> int | None:
    page = urn.strip("<>").split(":")[2]
    return None if page == "null" else int(page)


def page_row(fields: dict[str, str], block: bytes, name: str) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of a record of ours."""
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(head.lower().split(b"content-length:")[1].split(b"\r\n")[0])
    if kind == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
        raise WarcError(f"{name}: the payload differs from its digest or length")
    if kind not in ("response", "revisit"):
        raise WarcError(f"{name}: unexpected type {kind}")
    page = page_of(fields["warc-record-id"])
    return page, fields.get("warc-target-uri"), length, digest, kind, page_of(fields["warc-refers-to"]) if kind == "revisit" else None, payload if kind == "response" else None


ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in ROWS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for fields, block in read_file(content.as_buffer().to_pybytes(), name):
                    row = page_row(fields, block, name)
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(row[-1] or b"") + 200
                    if size >= 1 << 22:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, ROWS)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to (null for responses), sha1, bytes; revisits come without html."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    digest = [F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").cast("long").alias("bytes")]
    key = ["page_id", "sha1", "bytes"]
    slim = cut(pages.select("page_id", "url", *digest).where((F.col("bytes") >= min_revisit_bytes) & F.col("page_id").isNotNull()), "digests")
    groups = slim.groupBy("sha1", "bytes").agg(F.max("page_id").alias("leader"), F.count("*").alias("rows"))
    groups = cut(groups.where("rows > 1"), "copies")
    revisits = lookup(slim, groups, ["sha1", "bytes"], "rows", F.struct("page_id", "url")).where("page_id < leader")
    revisits = cut(revisits.select("page_id", "url", F.lit(None).cast("string").alias("html"), F.col("leader").alias("refers_to"), "sha1", "bytes"), "revisits")
    # pages whose id is no revisit's by the bitmap are responses where they are read
    rows = marked(pages.withColumn("bytes", F.octet_length("html").cast("long")), revisits, "page_id")
    asked = F.col("maybe") & F.col("page_id").isNotNull() & (F.col("bytes") >= min_revisit_bytes)
    # the others that are none after all (another page's bit, or another payload under the same id)
    wrong = cut(marked(slim, revisits, "page_id").where("maybe").join(revisits.select(*key), key, "left_anti").select(*key).distinct(), "wrong")
    rest = narrowed(rows.where(asked).select("page_id", "url", "html"), wrong, "page_id").select("page_id", "url", "html", *digest).join(wrong, key, "left_semi")
    nothing = [F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("long").alias("bytes")]
    responses = rows.where(~asked).select("page_id", "url", "html").unionAll(rest.select("page_id", "url", "html"))
    return responses.select("page_id", "url", "html", *nothing).unionAll(revisits)


def op4_warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(with_revisits(pages), path)
    return read(spark, path, payloads=False).drop("payload", "url")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, html, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS leader FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM s
"""
