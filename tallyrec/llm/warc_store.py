"""WARC archives in Zstandard members that share a dictionary.

Each task writes archives of bounded size.  It trains a dictionary on a bounded
run of the archive's own records (``TRAIN_BYTES``), puts it in a skippable frame at
the head of the file, and compresses every record as a frame of its own, so that
any record can be read from its offset and that dictionary alone.  Archives of too few
or too small records for training carry some of the records' own bytes as their dictionary.

Of pages with the same payload of at least ``min_bytes``, the one with the largest
id is a ``response``; the others are ``revisit`` records that name it.

Archives of a task have names that no other attempt uses; only those that the
manifest lists (written by Spark's own commit) are ever read.

Cases: null html is an empty payload; a null id is below all ids, and payloads
known by null ids only stay responses; rows that repeat both the largest id and
the payload are each a response; a null url gives no target line; a url that is no
valid header value is written percent-encoded, and read back as it was.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrec.llm.common import new_path, tasks_of

#: Payloads below this many bytes are never told apart by revisits.
MIN_BYTES = 1000
#: Bytes of an archive's first records that its dictionary is built from, and the dictionary's size.
TRAIN_BYTES, DICT_BYTES = 1 << 20, 32 << 10
#: Bytes of the samples that a few records are cut into.
PIECE = 128
#: Uncompressed bytes after which a task opens its next archive.
ARCHIVE_BYTES = 64 << 20
SKIPPABLE = 0x184D2A5D
LEVEL = 3
CHUNK = 1 << 16
#: Pages have no capture time, so the records carry this one.
CAPTURED = "1970-01-01T00:00:00Z"

MANIFEST = "path string, n_records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: the last is set where another page has the payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    # The group's size is reduced in each task first: a payload shared by a third of all pages is one row a task.
    large = rows.filter(F.col("size") >= min_bytes)
    groups = large.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    joined = large.join(groups.filter("n > 1").drop("n"), ["digest", "size"], "left")
    other = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    found = joined.select("page_id", "url", "html", "digest", F.when(other, F.col("last")).alias("refers_to"))
    # Small payloads are often the same (empty ones above all) and need no partner: they stay out of the join.
    small = rows.filter(F.col("size") < min_bytes).select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"))
    return found.unionByName(small)


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        shown = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
        head.append(f"WARC-Target-URI: {shown}")
        if shown != url:
            head.append(f"X-Page-URL: {quote(url, safe='')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    body = http + html
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(html)}"]
        body = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record's fields and its payload (None in a revisit)."""
    at = raw.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in raw[:at].decode().split("\r\n")[1:])
    body = raw[at + 4 : at + 4 + int(fields["Content-Length"])]
    fields["payload"] = None if fields["WARC-Type"] == "revisit" else body[body.index(b"\r\n\r\n") + 4 :]
    return fields


def dictionary(records: list[bytes]):
    """A dictionary of these records."""
    import zstandard as zstd

    # training wants several samples: few records are cut into pieces
    samples = records if len(records) >= 8 else [r[i : i + PIECE] for r in records for i in range(0, len(r), PIECE)]
    try:
        return zstd.train_dictionary(DICT_BYTES, samples, k=256, d=8, f=18, split_point=1.0, accel=4)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(records)[:DICT_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_tasks(folder: str, archive_bytes: int):
    def archive(first: list[bytes], rest: Iterator[bytes]) -> dict:
        import zstandard as zstd

        files, root = _files(folder)
        path = f"{root}/{uuid.uuid4().hex}.warc.zst"
        trained = dictionary(first)
        press = zstd.ZstdCompressor(level=LEVEL, dict_data=trained)
        n = size = 0
        # the stream must take the bytes as they are: by default it would compress them again for the file's suffix
        with files.open_output_stream(path, compression=None) as out:
            data = trained.as_bytes()
            out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
            for source in (first, rest):
                for raw in source:
                    out.write(press.compress(raw))
                    n, size = n + 1, size + len(raw)
                    if size >= archive_bytes and source is rest:
                        break
        return {"path": path.rsplit("/", 1)[1], "n_records": n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"], batch["digest"].to_pylist(), batch["refers_to"].to_pylist(), strict=True):
                    yield record(page_id, url, html.as_py().encode(), digest, refers_to)

        source = records()
        while True:
            first, held = [], 0
            for raw in source:
                first.append(raw)
                held += len(raw)
                if held >= TRAIN_BYTES:
                    break
            if not first:
                return
            yield pa.RecordBatch.from_pylist([archive(first, source)], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return run


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages (page_id, url, html)`` as archives in ``folder/data``; ``folder/manifest`` lists them."""
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    rows = with_revisits(pages, min_bytes).select("page_id", "url", "html", "digest", "refers_to")
    rows.mapInArrow(_write_tasks(f"{folder}/data", archive_bytes), MANIFEST).write.parquet(f"{folder}/manifest")


def _frames(stream) -> Iterator[bytes]:
    """The records of an open archive, one by one; holds one record and one chunk."""
    import zstandard as zstd

    buffer = stream.read(CHUNK)
    unpress = zstd.ZstdDecompressor()
    if len(buffer) >= 8 and struct.unpack_from("<I", buffer)[0] == SKIPPABLE:
        size = 8 + struct.unpack_from("<I", buffer, 4)[0]
        while len(buffer) < size:
            buffer += stream.read(size - len(buffer))
        unpress = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(buffer[8:size]))
        buffer = buffer[size:]
    buffer = buffer or stream.read(CHUNK)
    while buffer:
        frame, out = unpress.decompressobj(), []
        while not frame.eof:
            if not buffer and not (buffer := stream.read(CHUNK)):
                raise ValueError("the archive ends within a record")
            out.append(frame.decompress(buffer))
            buffer = frame.unused_data if frame.eof else b""
        yield b"".join(out)
        buffer = buffer or stream.read(CHUNK)


def _read_tasks(folder: str, with_payload: bool):
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def row(raw: bytes) -> dict:
        x = parse(raw)
        body = x["payload"]
        return {
            "page_id": int(x["X-Page-ID"]) if "X-Page-ID" in x else None,
            "url": unquote(x["X-Page-URL"]) if "X-Page-URL" in x else x.get("WARC-Target-URI"),
            "payload_bytes": int(x["X-Payload-Length"]) if body is None else len(body),
            "payload_digest": x["WARC-Payload-Digest"].removeprefix("sha1:") if body is None else hashlib.sha1(body).hexdigest(),
            "record_type": x["WARC-Type"],
            "refers_to": int(x["X-Refers-To-Page"]) if "X-Refers-To-Page" in x else None,
            "payload": body if with_payload else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            for name in batch["path"].to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    held: list[dict] = []
                    for raw in _frames(stream):
                        held.append(row(raw))
                        if len(held) == 256:
                            yield pa.RecordBatch.from_pylist(held, schema=kinds)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return run


def read_archives(spark: SparkSession, folder: str, *, with_payload: bool = True) -> DataFrame:
    """Every record of the archives that the manifest lists."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    dealt = manifest.repartition(tasks_of(spark), "path").select("path")
    return dealt.mapInArrow(_read_tasks(f"{folder}/data", with_payload), RECORDS)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write archives to the shared folder, then read every record's facts from them."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder, **options)
    return read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
