"""Token-id segments with Elias-Fano document boundaries.

A store is a table of binary *segments*, each self-describing:

    magic "EFT1" | id width | low bits | n_docs | n_ids | section sizes
    low bits of the document ends, packed
    high bits of the document ends, as a bit vector
    select samples: the place of every 64th one bit
    document ids (8 bytes each) and their null flags
    the ids of all documents, one after another

``n`` ends below ``u`` take about ``n * (2 + log2(u / n))`` bits in place of the
``64 * n`` of a plain offset table.  :func:`select` finds one end without
expanding the others.

Spark deals documents to tasks by ranges of their id, so (task, segment) order
is id order, and each segment knows how many ids its own task wrote before it.
Only one row a task (its total) is needed to turn this into global offsets.

Cases: null and empty texts hold the end id alone; null ids come first; rows
that repeat an id stay apart, in order of their texts; an empty table gives an
empty store; further columns are not read; the content of an added token within a text
is that token's id, as the tokenizers library gives it.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.llm.common import new_path, tasks_of, text_or_empty

MAGIC = b"EFT1"
HEADER = struct.Struct("<4sBBxxIQIIIII")
SAMPLE = 64
#: Ids after which a task closes a segment.
SEGMENT_IDS = 1 << 20
#: Distinct units of text a worker remembers the ids of.
CACHE = 400_000
#: Texts up to here are cut into the tokenizer's own units by the standard library's regex.
LATIN_END = 0x250
SPACE = "\t-\r \x85\xa0"
BEYOND = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]")


def _latin_units() -> re.Pattern:
    """The byte-level tokenizer's published rule (contractions, letters, numbers, others, white space) for Latin texts."""
    chars = [chr(c) for c in range(LATIN_END)]
    letters = "".join(re.escape(c) for c in chars if c.isalpha())
    numbers = "".join(c for c in chars if unicodedata.category(c)[0] == "N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


SEGMENTS = "part int, seg int, ids_before long, n_docs long, n_ids long, payload binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def elias_fano(ends: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """(low bits, packed lows, high bit vector, select samples) of rising ``ends``."""
    n = len(ends)
    low = max(0, int(universe // max(n, 1)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    lows = b""
    if low and n:
        bits = (ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    return low, lows, np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()


def _low(lows: np.ndarray, low: int, i: int) -> int:
    value = 0
    for k in range(low):
        at = i * low + k
        value |= int(lows[at >> 3] >> (at & 7) & 1) << k
    return value


class Segment:
    """Reads one segment."""

    def __init__(self, payload: bytes):
        magic, self.width, self.low, self.n_docs, self.n_ids, *sizes = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at, parts = HEADER.size, []
        for size in sizes:
            parts.append(np.frombuffer(payload, np.uint8, size, at))
            at += size
        self.lows, self.high, samples, ids, self.nulls = parts
        self.samples = samples.view("<u4")
        self.doc_ids = ids.view("<i8")
        self.ids = np.frombuffer(payload, f"<u{self.width}", self.n_ids, at)

    def select(self, i: int) -> int:
        """Where document ``i`` ends, from the samples and a short scan."""
        place, seen = int(self.samples[i // SAMPLE]), i - i % SAMPLE
        while seen < i:
            place += 1
            seen += int(self.high[place >> 3] >> (place & 7) & 1)
        return (place - i) << self.low | _low(self.lows, self.low, i)

    def ends(self) -> np.ndarray:
        """All ends at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n_docs]
        out = (ones - np.arange(self.n_docs)) << self.low
        if self.low and self.n_docs:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n_docs * self.low]
            out |= bits.reshape(self.n_docs, self.low).astype(np.int64) @ (1 << np.arange(self.low))
        return out.astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document."""
        return self.ids[self.select(i - 1) if i else 0 : self.select(i)]


def pack(doc_ids: list, lengths: list[int], ids: bytes, width: int) -> bytes:
    """One segment."""
    ends = np.cumsum(np.asarray(lengths, np.int64))
    total = int(ends[-1]) if len(ends) else 0
    low, lows, high, samples = elias_fano(ends, total)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    parts = [lows, high, samples, keys, nulls]
    return HEADER.pack(MAGIC, width, low, len(doc_ids), total, *map(len, parts)) + b"".join(parts) + ids


#: What a worker process has loaded and learned, kept from task to task.
_ENCODERS: dict[str, tuple] = {}


class _Units(dict):
    """Unit of text -> its ids' bytes, asked of the tokenizer's model once."""

    def __init__(self, model, width: int):
        super().__init__()
        self.model, self.code = model, "H" if width == 2 else "I"
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, unit: str) -> bytes:
        found = self.model.tokenize(unit.encode().decode("latin-1").translate(self.alphabet))
        value = self[unit] = array(self.code, [t.id for t in found]).tobytes()
        return value


def encoder(tokenizer_path: str):
    """(texts -> little-endian ids of each, id width), remembering the ids of units seen before."""
    if tokenizer_path in _ENCODERS:
        return _ENCODERS[tokenizer_path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
    spec = json.loads(tokenizer.to_str())
    rule = spec.get("pre_tokenizer") or {}
    plain = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and spec.get("normalizer") is None
    units, known = _latin_units(), _Units(tokenizer.model, width)
    # texts with an added token's content go to the library, which gives it as one id
    added = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens", []) if t["content"])
    aside = re.compile(f"{BEYOND.pattern}|{added}" if added else BEYOND.pattern)

    def encode(text: str) -> bytes:
        if not plain or aside.search(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, f"<u{width}").tobytes()
        if len(known) > CACHE:
            known.clear()
        return b"".join(map(known.__getitem__, units.findall(text)))

    _ENCODERS[tokenizer_path] = encode, width
    return encode, width


def _write_tasks(tokenizer_path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, width = encoder(tokenizer_path)
        end = end_id.to_bytes(width, "little")
        part, seg, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        lengths: list[int] = []
        ids: list[bytes] = []
        held = 0

        def close():
            nonlocal seg, before, docs, lengths, ids, held
            row = {"part": part, "seg": seg, "ids_before": before, "n_docs": len(docs), "n_ids": held, "payload": pack(docs, lengths, b"".join(ids), width)}
            seg, before, docs, lengths, ids, held = seg + 1, before + held, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("ids_before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids.append(encode(text.as_py()) + end)
                lengths.append(len(ids[-1]) // width)
                docs.append(doc_id)
                held += lengths[-1]
                if held >= segment_ids:
                    yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, *, tasks: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs (doc_id, text)`` into a store at ``path``, in order of id."""
    rows = docs.select("doc_id", text_or_empty()).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(tasks or tasks_of(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    dealt.select("doc_id", "text").mapInArrow(_write_tasks(tokenizer_path, end_id, segment_ids), SEGMENTS).write.parquet(path)


def _read_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, before, payload in zip(batch["base"].to_pylist(), batch["ids_before"].to_pylist(), batch["payload"], strict=True):
            segment = Segment(payload.as_py())
            ends = segment.ends()
            starts = np.concatenate([[0], ends[:-1]])
            wide = segment.ids.astype("<u4")
            crcs = [zlib.crc32(wide[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment.doc_ids.copy(), pa.int64(), mask=segment.nulls.astype(bool)), pa.array(starts + base + before, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: where its ids start in the whole, how many, their crc32."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # One row for each task that wrote: their number is fixed by the settings, not by the data.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    bases = totals.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("base"))
    return segments.join(F.broadcast(bases), "part").select("base", "ids_before", "payload").mapInArrow(_read_tasks, DOCUMENTS)


def token_offsets(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **options) -> DataFrame:
    """Write a store to the shared folder, then read every document's place from it."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, **options)
    return read_tokens(spark, path)
