"""WARC archives compressed with Zstandard and a shared dictionary.

An archive is a skippable frame (magic 0x184D2A5D) whose content is the
dictionary, itself plain or compressed, followed by one frame for each record.
``write`` makes one archive for each partition of its input; ``read`` streams
archives frame by frame, so a task holds one record and not an archive, and
checks every record's version line, headers, lengths and digests.

Files live in the shared folder and are reached by ``pyarrow.fs``, which serves
local, HDFS, S3 and GCS paths from the executors without the driver.
"""

from __future__ import annotations

import base64
import hashlib
import string
import struct
import uuid
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Largest record (headers and block) that a reader accepts, in bytes.
MAX_RECORD = 1 << 30


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _line(value: str) -> str:
    """A header's value without what would end its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _kept(value: str) -> str:
    """A header's value in which spaces at either end and percent signs survive."""
    return quote(value, safe=string.punctuation.replace("%", ""), errors="surrogatepass")


def record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None, date: str = "2024-01-01T00:00:00Z", at: str = "") -> bytes:
    """One record with its closing blank lines.

    A response is named by its page and payload, a revisit also by ``at``, its
    place; a null page has no header of its own.  A revisit's block holds the HTTP headers alone, among them the length of the
    payload that the record it refers to has in full.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}" + (f":{at}" if refers_to is not None else ""))
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _line(url)), *([("WARC-Page-ID", _kept(page_id))] if page_id is not None else []), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        target = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:{digest}")
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{target}>"), ("WARC-Refers-To-Page-ID", _kept(refers_to))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers), "\r\n"]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _given(value: str | None) -> str | None:
    return None if value is None else unquote(value, errors="surrogatepass")


def parse(raw: bytes) -> dict:
    """A record's headers and payload, validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise WarcError("no WARC version line, or no end of the headers")
    headers: dict[str, str] = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or name != name.strip():
            raise WarcError(f"malformed header {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"header {name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the block has {len(rest) - 4}")
    block = rest[:length]
    if (said := headers.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != payload_digest(block):
        raise WarcError("block digest differs")
    out = {"headers": headers, "payload": block, "payload_bytes": length}
    if headers.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise WarcError("no end of the HTTP headers")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}
        full = fields.get("content-length", "")
        out |= {"payload": payload, "payload_bytes": int(full) if full.isdigit() else len(payload)}
        if headers["warc-type"] == "response" and out["payload_bytes"] != len(payload):
            raise WarcError(f"HTTP Content-Length is {out['payload_bytes']}, the payload has {len(payload)}")
    if headers["warc-type"] == "response" and (said := headers.get("warc-payload-digest", "")).startswith("sha1:") and said[5:] != payload_digest(out["payload"]):
        raise WarcError("payload digest differs")
    return out


def train_dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A dictionary from samples; with too little to learn from, the samples' own bytes."""
    plain = b"".join(samples)[: size // 2] or b"WARC/1.1\r\n"
    try:
        if len(samples) >= 8 and sum(map(len, samples)) >= 8 * size:
            return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    return plain


def dictionary_frame(content: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(content)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one for each frame, from a stream read in chunks."""
    head = stream.read(8)
    if not head:
        return
    if len(head) < 8:
        raise WarcError("archive is cut off")
    magic, size = struct.unpack("<II", head)
    dictionary, data = None, head
    if magic == DICTIONARY_MAGIC:
        content = stream.read(size)
        if len(content) < size:
            raise WarcError("dictionary frame is cut off")
        if content[:4] == b"\x28\xb5\x2f\xfd":
            content = zstandard.ZstdDecompressor().decompress(content, max_output_size=64 << 20)
        dictionary, data = zstandard.ZstdCompressionDict(content), b""
    codec = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while data or (data := stream.read(chunk)):
        if len(data) < 4:
            data += stream.read(chunk)
        if len(data) >= 4 and 0x184D2A50 <= struct.unpack("<I", data[:4])[0] <= 0x184D2A5F:  # any other skippable frame
            while len(data) < 8 and (more := stream.read(chunk)):
                data += more
            if len(data) < 8:
                raise WarcError("skippable frame is cut off")
            skip = 8 + struct.unpack("<I", data[4:8])[0]
            while len(data) < skip:
                if not (more := stream.read(chunk)):
                    raise WarcError("skippable frame is cut off")
                data += more
            data = data[skip:]
            continue
        frame, out, size = codec.decompressobj(), [], 0
        while True:
            out.append(frame.decompress(data))
            size += len(out[-1])
            if size > MAX_RECORD:
                raise WarcError(f"record of over {MAX_RECORD} bytes")
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(chunk)):
                raise WarcError("frame is cut off")
        yield b"".join(out)


def first_of_payload(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """(id, sha, refers_to): for every row, the smallest id with an equal payload, where that is another one.

    Copies are counted before anything is joined, and only payloads that have
    copies are joined back, on rows of an id and a digest; a payload that a
    large part of the rows share is a skewed side that the adaptive join splits.
    """
    slim = pages.select(F.col(id_col).alias("_id"), F.sha1(common.text_or_empty(payload_col).cast("binary")).alias("_sha"), F.octet_length(common.text_or_empty(payload_col)).alias("_bytes"))
    slim = slim.where(F.col("_bytes") >= min_bytes)
    firsts = slim.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return slim.join(firsts, "_sha").where("_id > _first").select("_id", "_sha", F.col("_first").alias("refers_to")).distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, sample: int = 128) -> DataFrame:
    """Writes one archive for each partition below ``folder``; returns its manifest (path, records, bytes), computed once.

    The dictionary of an archive is trained on its first ``sample`` records.  An
    archive is written under a name of its own attempt and then renamed, so a
    task that runs twice leaves one whole archive.  Null payloads and urls are
    empty; rows that repeat an id get a record each, which revisits another only
    for its own payload.  Rows with a null id are never revisited unless no other
    has their payload, and never revisit.  An empty table gives no archive.
    """
    revisits = first_of_payload(pages, id_col, payload_col, min_bytes)
    todo = pages.select(F.col(id_col).alias("_id"), common.text_or_empty(url_col).alias("url"), common.text_or_empty(payload_col).alias("payload"))
    todo = todo.withColumn("_sha", F.sha1(F.col("payload").cast("binary"))).join(revisits, ["_id", "_sha"], "left").select(
        F.col("_id").cast("string").alias("page"), "url", F.col("payload").cast("binary").alias("payload"), F.col("refers_to").cast("string").alias("refers_to")
    )

    def archive(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        temporary, held, out, codec = f"{base}/.{uuid.uuid4().hex}", [], None, None
        count = size = 0

        def put(records: list[bytes]) -> int:
            n = 0
            for r in records:
                n += out.write(f := codec.compress(r)) or len(f)
            return n

        def start() -> int:
            nonlocal out, codec
            content = train_dictionary(held)
            codec = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
            out = fs.open_output_stream(temporary, compression=None)
            return (out.write(f := dictionary_frame(content)) or len(f)) + put(held)

        for b in it:
            for k in range(0, b.num_rows, 256):
                page, url, payload, refers = (c.to_pylist() for c in b.slice(k, 256).columns)
                made = [record(p, u, x, payload_digest(x), r, at=f"{TaskContext.get().partitionId()}:{count + i}") for i, (p, u, x, r) in enumerate(zip(page, url, payload, refers, strict=True))]
                count += len(made)
                if out is None:
                    held += made
                    if len(held) >= sample:
                        size += start()
                else:
                    size += put(made)
        if out is None and held:
            size += start()
        if out is not None:
            out.close()
            path = f"{base}/{TaskContext.get().partitionId():06d}.warc.zst"
            fs.move(temporary, path)
            yield pa.record_batch([[folder.rstrip("/") + path[len(base.rstrip("/")) :]], [count], [size]], names=["path", "records", "bytes"])

    return common.stored(todo.mapInArrow(archive, "path string, records long, bytes long"), "manifest")


_READ = "page string, url string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that ``archives.path`` names, each validated; one that breaks the format fails the query.

    ``payload_digest`` is computed from the payload of a response and taken from
    the header of a revisit.  Archives are dealt over tasks by their bytes.
    """
    n = max(1, archives.count())

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        for b in it:
            for path in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for raw in read_archive(stream):
                        r = parse(raw)
                        h = r["headers"]
                        is_response = h["warc-type"] == "response"
                        rows.append((
                            _given(h.get("warc-page-id")), h.get("warc-target-uri"), h["warc-type"], h["warc-record-id"], r["payload_bytes"],
                            payload_digest(r["payload"]) if is_response else h.get("warc-payload-digest", "").removeprefix("sha1:"),
                            _given(h.get("warc-refers-to-page-id")), r["payload"] if with_payload else None,
                        ))
                        held += len(raw)
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return archives.select("path").repartition(n).mapInArrow(records, _READ)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, id_col: str = "page_id", **more) -> DataFrame:
    """Writes ``pages`` to archives and reads them: (id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    back = read(spark, write(pages, common.scratch(spark, "warc"), id_col, **more), with_payload=False)
    return back.select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def from_bytes(content: bytes) -> list[dict]:
    return [parse(r) for r in read_archive(BytesIO(content))]
