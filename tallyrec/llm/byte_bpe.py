"""Byte-level BPE encoding and decoding of long texts in overlapping chunks.

A text is cut into chunks that overlap by ``OVERLAP`` characters.  Each chunk is
cut into pre-tokens by itself, wherever it lies.  The pattern only looks
ahead, so once two neighbours have a boundary at the same place they agree from there on: the first
common boundary of the overlap is the seam.  Boundaries near a chunk's end, which what
follows could change, and those after white space, which a look-ahead could change, are no seams.
Pieces from seam to seam are then encoded in parallel, and a document's ids are its pieces' ids in order.
Decoding concatenates the raw bytes of the ids.

Where an overlap has no common boundary (one pre-token longer than it), the chunks are joined
and tried again, so the result is the same for any chunk size.  A text of one chunk has no seams and
is encoded where it is read.  A document's digests run over its pieces in order, piece by piece, so
no task holds a whole document's ids.

Cases: null and empty texts have no ids and the digests of nothing; null ids are documents like others;
rows that repeat an id stay apart; an empty table gives an empty table; further columns are not read; the strings of
special tokens are plain text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.llm.common import stage, tasks_of, text_or_empty
from tallyrec.llm.token_store import BEYOND, CACHE, _latin_units

#: Characters of a chunk, of an overlap, and at a chunk's end where no boundary is trusted.
CHUNK, OVERLAP, MARGIN = 1 << 15, 256, 4
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """The ranks of one vocabulary file under one pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # the library's white space is Unicode's property
        self.any_units = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.latin_units = _latin_units() if pattern == PATTERN_OF_LATIN_UNITS else None
        self.known: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if self.latin_units is None or BEYOND.search(text):
            return self.any_units.findall(text)
        return self.latin_units.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.latin_units is None or BEYOND.search(text):
            return np.array(self.library.encode_ordinary(text), "<u4").tobytes()
        if len(self.known) > CACHE:
            self.known.clear()
        known, units = self.known, self.latin_units.findall(text)
        try:
            return b"".join(map(known.__getitem__, units))
        except KeyError:
            for unit in set(units).difference(known):
                known[unit] = np.array(self.library.encode_ordinary(unit), "<u4").tobytes()
            return b"".join(map(known.__getitem__, units))

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes of ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Fixed value: the pattern whose units ``_latin_units`` gives for Latin texts.
PATTERN_OF_LATIN_UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """A worker's codec, made once."""
    key = ranks_path, pattern
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def _digests(doc_ids, parts: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, ids, decoded = zip(*parts, strict=True) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _whole_tasks(vocabulary: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocabulary)
        for batch in batches:
            parts = []
            for text in batch["text"]:
                ids = own.encode(text.as_py())
                parts.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield _digests(batch["doc_id"], parts)

    return run


CHUNKS = "key long, doc_id long, no long, at long, own long, text string"
_CHUNKS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int64()), ("at", pa.int64()), ("own", pa.int64()), ("text", pa.string())])


def _cut_tasks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(batch["key"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                n = max(1, -((overlap - len(text)) // chunk))
                for k in range(0, n, 64):
                    rows = [(key, doc_id, i, i * chunk, chunk, text[i * chunk : (i + 1) * chunk + overlap]) for i in range(k, min(n, k + 64))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _CHUNKS, strict=True)], schema=_CHUNKS)

    return run


def chunks_of(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping chunks of every text: ``key`` tells rows apart, ``at`` is where a chunk starts, ``own`` how far the next one is."""
    keyed = docs.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "text")
    dealt = keyed.mapInArrow(_cut_tasks(chunk, overlap), CHUNKS).repartition(tasks_of(docs.sparkSession), "key", "no")
    return stage(dealt, "chunks")


def _mark_tasks(vocabulary: tuple[str, str], overlap: int, margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocabulary)
        for batch in batches:
            heads, tails = [], []
            for at, size, text in zip(batch["at"].to_pylist(), batch["own"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                units = own.units(text)
                ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
                solid = np.fromiter((not u[-1].isspace() for u in units), bool, len(units))
                heads.append([at, *(ends[solid & (ends <= overlap)] + at).tolist()])
                tails.append((ends[solid & (ends >= size) & (ends <= len(text) - margin)] + at).tolist())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["no"], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["key", "no", "heads", "tails"])

    return run


def seams_of(chunks: DataFrame, vocabulary: tuple[str, str], overlap: int = OVERLAP, margin: int = MARGIN) -> DataFrame:
    """``key, no, seam, next_seam``: where each chunk's piece starts and ends; null seams are yet to be found."""
    marks = chunks.select("key", "no", "at", "own", "text").mapInArrow(_mark_tasks(vocabulary, overlap, margin), "key long, no long, heads array<long>, tails array<long>")
    order = W.partitionBy("key").orderBy("no")
    common = F.array_min(F.array_intersect(F.lag("tails").over(order), "heads"))
    seams = marks.select("key", "no", F.when(F.lag("no").over(order).isNull(), F.lit(0)).otherwise(common).cast("long").alias("seam"))
    return seams.withColumn("next_seam", F.lead("seam").over(order))


def _joined(chunks: DataFrame, seams: DataFrame) -> DataFrame:
    """Chunks without a seam appended to those before them."""
    order = W.partitionBy("key").orderBy("no")
    runs = seams.select("key", "no", F.count("seam").over(order).alias("run"))
    part = F.struct("no", "own", "text")
    grouped = chunks.join(runs, ["key", "no"]).groupBy("key", "run").agg(F.first("doc_id").alias("doc_id"), F.min("no").alias("no"), F.min("at").alias("at"), F.sum("own").alias("own"), F.array_sort(F.collect_list(part)).alias("parts"))
    # only the last one's overlap stays
    begun = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: F.substring(p["text"], F.lit(1), p["own"].cast("int")))
    return grouped.select("key", "doc_id", "no", "at", "own", F.concat(F.array_join(begun, ""), F.element_at("parts", -1)["text"]).alias("text"))


def pieces_of(chunks: DataFrame, vocabulary: tuple[str, str], overlap: int = OVERLAP, margin: int = MARGIN) -> DataFrame:
    """``key, doc_id, no, text``: the texts cut at seams, in order of ``no``."""
    while True:
        seams = stage(seams_of(chunks, vocabulary, overlap, margin), "seams")
        if not seams.filter("seam is null").limit(1).count():
            break
        chunks = stage(_joined(chunks, seams), "joined-chunks")
    start = (F.col("seam") - F.col("at") + 1).cast("int")
    size = F.coalesce(F.col("next_seam") - F.col("seam"), F.length("text").cast("long")).cast("int")
    return chunks.join(seams, ["key", "no"]).select("key", "doc_id", "no", F.substring("text", start, size).alias("text"))


def _encode_tasks(vocabulary: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocabulary)
        for batch in batches:
            ids = pa.array([own.encode(t.as_py()) for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], batch["no"], ids], ["key", "doc_id", "no", "ids"])

    return run


def _decode_tasks(vocabulary: tuple[str, str]):
    """Digests of documents whose pieces come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocabulary)
        now = None
        for batch in batches:
            ids_of, parts = [], []
            for key, doc_id, ids in zip(batch["key"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                if now is None or now[0] != key:
                    if now is not None:
                        ids_of.append(now[1])
                        parts.append((now[2], now[3].hexdigest(), now[4].hexdigest()))
                    now = [key, doc_id, 0, hashlib.sha256(), hashlib.sha256()]
                ids = ids.as_py()
                now[2] += len(ids) // 4
                now[3].update(ids)
                now[4].update(own.decode(ids))
            yield _digests(ids_of, parts)
        if now is not None:
            yield _digests([now[1]], [(now[2], now[3].hexdigest(), now[4].hexdigest())])

    return run


def encode_pieces(pieces: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """``key, doc_id, no, ids``: each piece's ids as little-endian 32-bit integers."""
    return pieces.select("key", "doc_id", "no", "text").mapInArrow(_encode_tasks(vocabulary), "key long, doc_id long, no long, ids binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs (doc_id, text)``."""
    vocabulary = ranks_path, pattern
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty())
    whole = rows.filter(F.length("text") <= chunk + overlap).mapInArrow(_whole_tasks(vocabulary), DIGESTS)
    chunks = chunks_of(rows.filter(F.length("text") > chunk + overlap), chunk, overlap)
    encoded = encode_pieces(pieces_of(chunks, vocabulary, overlap, margin), vocabulary)
    dealt = encoded.repartition(tasks_of(docs.sparkSession), "key").sortWithinPartitions("key", "no")
    return whole.unionByName(dealt.mapInArrow(_decode_tasks(vocabulary), DIGESTS))
