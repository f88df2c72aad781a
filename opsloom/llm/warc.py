"""WARC archives: a writer of records and revisits, and a reader that salvages damaged files.

Writing uses Spark's text sink, so any store that Spark writes to will do: each row is one complete gzip member and the
sink's line separator is the member's own last byte. Files are committed as Spark commits any output.

Reading takes whole files from Spark's ``binaryFile`` source. After a failed check the reader looks for the next gzip
member, or the next version line in plain files, goes on from there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import BATCH_BYTES, map_batches, prepare, saved, shared_dir

#: Payloads of at least so many bytes are stored once; later records of it are revisits.
LEAST_REVISIT = 1000
#: Records in a file at most, so that no file outgrows a task's memory.
RECORDS_PER_FILE = 4000
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"(?m)^WARC/\d\.\d\r\n")
#: An empty gzip member; its last byte is 0, as is that of every member of less than 16 MiB.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: Digests that are checked, by name.
_DIGESTS = {name: getattr(hashlib, name) for name in ("md5", "sha1", "sha256", "sha512")}
_HEX = re.compile(rb"[0-9a-fA-F]+")
#: Bytes given to zlib at once.
_PIECE = 1 << 15
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to), one for each page.

    A revisit has no payload here, but its length and digest. A null html is an empty payload. Of equal payloads of LEAST_REVISIT bytes or more, the largest page_id is the
    response and the others revisit it; rows that repeat that page_id are responses too. A null page_id revisits the
    response if there is one, else it is a response.
    """
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # The verdicts come from keys alone: a payload that a third of all pages share is a third of these small rows, in a
    # join that adaptive execution can split.
    keys = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).select("page_id", "payload_bytes", "payload_digest")
    shared = (
        keys.groupBy("payload_bytes", "payload_digest")
        .agg(F.count("*").alias("__n"), F.max("page_id").alias("__top"))
        .where("__n > 1 and __top is not null")
        .select("payload_bytes", "payload_digest", "__top")
    )
    told = keys.join(shared, ["payload_bytes", "payload_digest"]).where("page_id is null or page_id <> __top")
    told = saved(told.select(F.col("page_id").alias("__id"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest"), "__top").distinct())
    # A payload moves once, dealt out by page, past a table of the partition's revisits: it is never sorted.
    mine = F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes"))
    revisits = F.col("__top").isNotNull()
    return rows.join(told.hint("shuffle_hash"), mine, "left").select(
        "page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.col("__top").alias("refers_to"),
    )


def _clean(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, digest: str, kind: str, refers_to: int | None, length: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its headers tell the payload's digest and ``length``."""
    length = len(payload or b"") if length is None else length
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    block = payload if payload and kind != "revisit" else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return b"".join(("\r\n".join(head).encode("utf-8", "replace"), b"\r\n\r\n", block, b"\r\n\r\n"))


def write(records: DataFrame, path: str, level: int = 6) -> None:
    """Write the rows of ``plan_records`` to ``path`` as ``.warc.gz`` files of one gzip member a record.

    An empty table writes a folder without records.
    """
    prepare(records.sparkSession)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in zip(*batch.columns):  # a payload at a time becomes a Python object
            member = gzip.compress(record_bytes(*[x.as_py() for x in row]), level, mtime=0)
            out.append((member if member[-1] == 0 else member + _EMPTY_MEMBER)[:-1])
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = map_batches(records.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "payload_bytes"), pack, "member binary")
    sink = members.select(F.col("member").cast("string").alias("value")).write
    sink.option("lineSep", "\x00").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parse(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """Headers of the plain record at ``at``, and where its block begins and ends; None if there is no whole record."""
    if not _VERSION.match(data, at):
        return None
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or "warc-type" not in fields:
        return None
    begin, end = head + 4, head + 4 + int(length)
    return (fields, begin, end) if data[end : end + 4] == b"\r\n\r\n" else None


def _same(told: str, data: bytes) -> bool | None:
    """Whether ``data`` has the digest ``told`` (algorithm:value, in hex or base32); None if it names no algorithm known here."""
    kind, _, value = told.partition(":")
    make = _DIGESTS.get(kind.strip().lower().replace("-", ""))
    if make is None:
        return None
    found, value = make(data).digest(), value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _unchunked(body: bytes) -> bytes | None:
    """An HTTP body without its chunked transfer coding; None if it has none."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not _HEX.fullmatch(size):
            return None
        if not int(size, 16):
            return b"".join(out)
        begin, end = line + 2, line + 2 + int(size, 16)
        if body[end : end + 2] != b"\r\n":
            return None
        out.append(body[begin:end])
        at = end + 2


def _intact(fields: dict[str, str], block: bytes) -> bool:
    """The block has its digest, and so has the payload: what follows the HTTP headers where there are such, else the block.

    Writers differ on whether the payload has its transfer coding; either will do. A revisit's payload and that of a
    segment are not in the record.
    """
    if _same(fields.get("warc-block-digest", ""), block) is False:
        return False
    told = fields.get("warc-payload-digest", "")
    if fields["warc-type"].lower() in ("revisit", "continuation") or "warc-segment-number" in fields:
        return True
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return _same(told, block) is not False
    head, blank, body = block.partition(b"\r\n\r\n")
    if _same(told, body) is not False:
        return True
    plain = _unchunked(body) if b"chunked" in head.lower() else None
    return plain is not None and bool(_same(told, plain))


def _plain(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    at, bad = 0, None
    while at < len(data):
        found = _parse(data, at)
        if found and _intact(found[0], data[found[1] : found[2]]):
            if bad is not None:
                yield bad, at, None, b""
                bad = None
            yield at, found[2] + 4, found[0], data[found[1] : found[2]]
            at = found[2] + 4
        else:
            bad = at if bad is None else bad
            later = _VERSION.search(data, at + 1)
            at = later.start() if later else len(data)
    if bad is not None:
        yield bad, len(data), None, b""


def _member(data: bytes, at: int) -> tuple[bytes, int | None, bool]:
    """What the gzip member at ``at`` holds, its end (None if it is broken or cut off), and whether it is broken."""
    for fine in (False, True):  # zlib keeps back all of a piece that it fails on, so the piece is given again byte by byte
        unzip, fed, plain, piece = zlib.decompressobj(31), at, [], _PIECE
        try:
            while not unzip.eof and fed < len(data):  # piece by piece: what lies behind the member is not copied
                if fine and fed >= failed:
                    piece = 1
                plain.append(unzip.decompress(data[fed : fed + piece]))
                fed += piece
            return b"".join(plain), min(fed, len(data)) - len(unzip.unused_data) if unzip.eof else None, False
        except zlib.error:
            failed = fed
    return b"".join(plain), None, True


def _zipped(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    at, bad = 0, None
    while at < len(data):
        plain, end, broken = _member(data, at) if data.startswith(_MEMBER, at) else (b"", None, False)
        inner = list(_plain(plain))
        good = [(fields, block) for _, _, fields, block in inner if fields is not None]
        whole = end is not None and len(good) == len(inner)
        if broken and len(inner) == 1:  # what is broken is in this record, in its headers if its digest holds
            good = []
        if end is None:
            later = data.find(_MEMBER, at + 1)
            end = later if later >= 0 else len(data)
        if bad is not None and (good or whole):
            yield bad, at, None, b""
            bad = None
        for fields, block in good:
            yield at, end, fields, block
        if not whole:
            bad = at if bad is None else bad
        at = end
    if bad is not None:
        yield bad, len(data), None, b""


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """Records of an archive: (first byte, end, headers, block); a gap of unreadable bytes has None for headers.

    A record in a gzip member has the member's bytes. A member that is broken, cut off or holds bad records yields the
    records that can be read, and is told as a gap besides; the only record of a broken member is not yielded. Where a
    checksum fails and no record shows it, a header among those yielded may be wrong. Empty data has no rows.
    """
    return _zipped(data) if data[:2] == _MEMBER[:2] or (not _VERSION.match(data) and _MEMBER in data) else _plain(data)


READ = "file string, first_byte long, end_byte long, gap boolean, record_type string, record_id string, url string, refers_to string, payload_digest string, payload_length long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``, see READ; ``payload`` is null unless ``payloads``.

    ``payload_digest`` and ``payload_length`` are those of the block read for responses, and as told by its headers
    for a revisit. Gaps have ``gap`` true and nulls beyond ``end_byte``.
    """
    prepare(spark)
    # Batches end after so many bytes (see ``prepare``), so a task holds one large file or some small ones at a time.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("gap", pa.bool_()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for first, end, fields, block in salvage(content.as_py()):
                    if fields is None:
                        rows.append((name, first, end, True, *[None] * 7))
                    else:
                        kind = fields["warc-type"]
                        told = fields.get("x-payload-length", "")
                        digest = hashlib.sha1(block).hexdigest() if kind != "revisit" else fields.get("warc-payload-digest", "").rpartition(":")[2].lower()
                        length = len(block) if kind != "revisit" else int(told) if told.isdigit() else None
                        rows.append((name, first, end, False, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, length, block if payloads else None))
                    held += len(block) if payloads else 0
                    if len(rows) == 1000 or held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(unpack, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to the shared folder and read the archives back: a row for each record."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/opsloom/warc-{uuid.uuid4().hex}"
    write(plan_records(pages), path)
    return read(spark, path, payloads=False)


def page_number(column: str) -> Column:
    """The page_id in a record id of ``record_bytes``; null where there is none."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
