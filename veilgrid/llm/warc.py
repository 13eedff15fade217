"""WARC archives: written as one gzip stream, normalised to a member for each record with an offset index, and read back."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import Scratch
from .training_order import _attempt, filesystem

#: A digest that has one of so many records is met by broadcast: there can be no more such digests than this.
HOT = 1_000
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(page: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record with its HTTP block, or, with refers_to, a revisit record without the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {size}",
        *([] if page is None else [f"X-Page-Id: {page}"]),
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, inflated once, in bounded pieces."""
    unzip, whole = zlib.decompressobj(31), True
    while data := stream.read(1 << 20):
        while data:
            if whole:
                unzip, whole = zlib.decompressobj(31), False
            yield unzip.decompress(data, 4 << 20)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, 4 << 20)
            data = unzip.unused_data
            whole = unzip.eof
    if not whole:
        yield unzip.flush()
        if not unzip.eof:
            raise ValueError("the gzip stream ends early")


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields (names in lower case), block, and the record's own bytes, of a WARC stream."""
    buffer = bytearray()
    parts = iter(parts)

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            buffer.extend(part)
        return part is not None

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("a record's header is cut off")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + 4 + int(head["content-length"])
        while len(buffer) < size + 4:
            if not more():
                raise ValueError("a record's block is cut off")
        yield head, bytes(buffer[end + 4 : size]), bytes(buffer[: size + 4])
        del buffer[: size + 4]


def write_archives(rows: DataFrame, folder: str, date: str, level: int = 1) -> DataFrame:
    """Writes rows (page_id, url, packed html, payload_bytes, digest, refers_to) as archives of one gzip stream; rows (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        files, at = filesystem(folder)
        part, number, out, unzip = TaskContext.get().partitionId(), 0, None, zstandard.ZstdDecompressor()

        def close():
            stream.write(zip_.flush())
            stream.close()
            files.move(f"{name}.{_attempt()}.tmp", name)
            return pa.RecordBatch.from_pydict({"path": [name], "records": [count]})

        for batch in batches:
            for x in batch.to_pylist():
                if out is None:
                    files.create_dir(at, recursive=True)
                    name = f"{at}/part-{part:06d}-{number:04d}.warc.gz"
                    stream = out = files.open_output_stream(f"{name}.{_attempt()}.tmp", compression=None)
                    zip_, size, count = zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                payload = unzip.decompress(x["packed"]) if x["refers_to"] is None else b""
                data = record(x["page_id"], x["url"] or "", payload, x["payload_bytes"], x["digest"], x["refers_to"], date)
                stream.write(zip_.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return rows.mapInArrow(run, "path string, records long")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites archives (path): every record becomes a gzip member of its own, and a sidecar lists the members' offsets.

    Each archive is one stream and is inflated once, in pieces; memory holds one record. Both files are written under other
    names and renamed when whole. A stream that ends early or is no WARC fails the job.
    Rows: path (of the new archive), offset, length, record_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = filesystem(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files.create_dir(at, recursive=True)
                name = f"{at}/{path.rsplit('/', 1)[-1]}"
                index: list[tuple[int, int, str]] = []
                with files.open_input_stream(path, compression=None) as source, files.open_output_stream(tmp := f"{name}.{_attempt()}.tmp", compression=None) as out:
                    offset = 0
                    for head, _, data in records(_inflated(source)):
                        zip_ = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = zip_.compress(data) + zip_.flush()
                        out.write(member)
                        index.append((offset, len(member), head["warc-record-id"]))
                        offset += len(member)
                with files.open_output_stream(side := f"{name}.{_attempt()}.idx.tmp") as f:
                    f.write("".join(json.dumps({"offset": o, "length": n, "record_id": i}) + "\n" for o, n, i in index).encode())
                files.move(tmp, name)
                files.move(side, f"{name}.idx")
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(index), pa.string()), "offset": pa.array([o for o, _, _ in index], pa.int64()), "length": pa.array([n for _, n, _ in index], pa.int64()), "record_id": pa.array([i for _, _, i in index], pa.string())})

    return archives.select("path").mapInArrow(run, "path string, offset long, length long, record_id string")


def read_members(index: DataFrame, folder: str, each: Callable[[dict[str, str], bytes], dict], schema: pa.Schema, ddl: str) -> DataFrame:
    """Reads the records that index rows (path, offset, length) name, by one seek each, and gives each one's header and block to `each`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != name:
                    name, source = path, files.open_input_file(path)
                source.seek(offset)
                for head, block, _ in records([zlib.decompress(source.read(length), 31)]):
                    out.append(each(head, block))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return index.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, ddl)


def read_page(head: dict[str, str], block: bytes) -> dict:
    """What a record says of its page; of a response, the payload itself is measured and must bear its header out."""
    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-bytes"])
    kind = head["warc-type"]
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if payload_digest(payload) != digest or len(payload) != size:
            raise ValueError(f"the payload of {head['warc-record-id']} doesn't match its header")
    page, other = head.get("x-page-id"), head.get("x-refers-to-page")
    return {"page_id": page and int(page), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": other and int(other)}


def archive_pages(df: DataFrame, id_col: str, url_col: str, html_col: str, scratch: Scratch, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each page, normalises the archives, and returns their offset index.

    Of equal payloads (equal SHA-1) of at least `least` bytes, the pages with the largest id are responses, all others
    revisits of it; a null id is smaller than any, and pages that all lack an id are all responses. A null payload is
    empty, a null URL too. Repeated rows get a record each. An empty table gives no archive and no rows. Other columns
    are ignored, whatever their names.

    Copies of a hot payload learn of their response by broadcast and lose the payload before anything moves; then they
    are dealt by page, so that no digest is one task's matter.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            html = [(x or "").encode() for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([zip_.compress(x) for x in html], pa.binary()), pa.array([len(x) for x in html], pa.int64()), pa.array([payload_digest(x) for x in html])], ["page_id", "url", "packed", "payload_bytes", "digest"])

    def only_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = pc.fill_null(b.column("html"), "").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([payload_digest(x.as_buffer()) for x in html])], ["page_id", "digest"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    digests = rows.select("page_id", "html").mapInArrow(only_digest, "page_id long, digest string")
    last = scratch.save(digests.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")), "digests")
    n = last.agg(F.sum("n")).first()[0] or 0
    hot = last.where(F.col("n") * HOT >= n).select("digest", F.col("last").alias("hot_last"), F.lit(True).alias("hot"))
    rest = last.where(F.col("n") * HOT < n).select(F.col("digest").alias("dealt"), "last")

    def refers(to: str):
        return F.when((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col(to)), F.col(to))

    full = rows.mapInArrow(digested, "page_id long, url string, packed binary, payload_bytes long, digest string").join(F.broadcast(hot), "digest", "left")
    full = full.withColumn("hot_refers", F.when(F.col("hot"), refers("hot_last"))).withColumn("packed", F.when(F.col("hot_refers").isNull(), F.col("packed")))
    by_page = F.concat_ws(":", "digest", F.xxhash64("page_id", "url").cast("string"))
    told = full.withColumn("dealt", F.when(F.col("hot"), by_page).otherwise(F.col("digest"))).join(rest, "dealt", "left")
    told = told.withColumn("refers_to", F.when(F.col("hot"), F.col("hot_refers")).otherwise(refers("last")))
    packed = told.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("packed")).alias("packed"), "payload_bytes", "digest", "refers_to")
    whole = scratch.save(write_archives(packed, f"{scratch.root}/streams", date), "written")
    return scratch.save(normalise(whole.repartition(max(1, whole.count())), f"{scratch.root}/archives"), "index")


def op8_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its WARC record tells it, read by the offset index of the normalised archives."""
    scratch = Scratch(spark)
    index = archive_pages(table(spark, sf_dir, "pages"), "page_id", "url", "html", scratch)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return read_members(index, scratch.root, read_page, schema, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
