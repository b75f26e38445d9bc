"""Conflict-constrained best-fit packing.

Documents are dealt by hash into groups of bounded size; each group is packed by
itself, the longest first.  A document goes to the bin with the smallest residual
that holds it and has neither its source nor its duplicate cluster yet.  Bins are
kept by residual and carry a bitmap of sources and one of clusters; if the tightest
bins conflict, the search goes on to the next residual until one fits, and a
new bin is opened only if none does.

A document longer than a bin fills whole bins by itself; its rest is packed.

Lengths are the ids that a tokenizer gives, or words where none is named, and an end id.  Duplicate
clusters are the groups of near copies that SimHash fingerprints link.

Cases: an empty or null text has length one (its end id); a null source or cluster
conflicts with nothing; repeated rows are packed each, in bins of their own as they are of one
cluster; of equal lengths the smallest id is packed first; null ids are packed like others; an empty table gives no bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrec.llm.common import released, stage
from tallyrec.llm.simhash import near_rows
from tallyrec.llm.token_store import encoder

CAPACITY = 2048
#: Documents of a group, about.  More of them pack a little tighter and take longer.
GROUP = 20_000
#: Sources and clusters with this many documents in a group are counted by residual, to skip full residuals at once.
COUNTED = 16

PACKED = "doc_id long, piece int, start int, n_tokens int, bin_id long, position int"


class Bins:
    """The open bins of one group."""

    def __init__(self, capacity: int, keys: int):
        self.capacity = capacity
        self.total = np.zeros(capacity + 1, np.int32)
        #: bins of each residual that hold a counted key
        self.holding = np.zeros((keys, capacity + 1), np.int32)
        #: residual -> (source bitmap, cluster bitmap) -> bins
        self.at: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        self.count = 0
        self.rows: dict[int, list[int]] = {}

    def _move(self, bin_id: int, residual: int, sign: int) -> None:
        self.total[residual] += sign
        for k in self.rows[bin_id]:
            self.holding[k, residual] += sign

    def place(self, size: int, source: int, cluster: int, keys: list[int]) -> tuple[int, int]:
        """(bin, how much it held before) for a document with these bits."""
        room = self.total[size:] > 0
        for k in keys:
            room &= self.total[size:] > self.holding[k, size:]
        for residual in (np.flatnonzero(room) + size).tolist():
            for (sources, clusters), found in self.at[residual].items():
                if not (sources & source or clusters & cluster):
                    return self._add(found[-1], residual, size, sources, clusters, source, cluster, keys)
        self.count += 1
        bin_id = self.count - 1
        self.rows[bin_id] = []
        self.at[self.capacity].setdefault((0, 0), []).append(bin_id)
        self._move(bin_id, self.capacity, 1)
        return self._add(bin_id, self.capacity, size, 0, 0, source, cluster, keys)

    def _add(self, bin_id, residual, size, sources, clusters, source, cluster, keys) -> tuple[int, int]:
        found = self.at[residual][sources, clusters]
        found.pop()
        if not found:
            del self.at[residual][sources, clusters]
        self._move(bin_id, residual, -1)
        left = residual - size
        if left:
            self.rows[bin_id] += keys
            self.at[left].setdefault((sources | source, clusters | cluster), []).append(bin_id)
            self._move(bin_id, left, 1)
        else:
            del self.rows[bin_id]
        return bin_id, self.capacity - residual


def pack_group(docs: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """Rows ``doc_id, piece, start, n_tokens, bin, position`` for ``docs (doc_id, source, cluster, length)``."""
    sources = Counter(d[1] for d in docs if d[1] is not None)
    clusters = Counter(d[2] for d in docs if d[2] is not None)
    bit = {s: 1 << i for i, s in enumerate(sources)}
    shared = {c: 1 << i for i, (c, n) in enumerate(x for x in clusters.items() if x[1] > 1)}
    counted = {("s", s): 0 for s, n in sources.items() if n >= COUNTED} | {("c", c): 0 for c, n in clusters.items() if n >= COUNTED}
    counted = {key: i for i, key in enumerate(counted)}
    bins, out = Bins(capacity, len(counted)), []
    for doc_id, source, cluster, length in docs:
        for piece in range(length // capacity):
            out.append((doc_id, piece, piece * capacity, capacity, bins.count, 0))
            bins.count += 1
    rests = sorted(((d, s, c, n // capacity, n % capacity) for d, s, c, n in docs if n % capacity), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for doc_id, source, cluster, whole, size in rests:
        keys = [counted[k] for k in (("s", source), ("c", cluster)) if k in counted]
        bin_id, held = bins.place(size, bit.get(source, 0), shared.get(cluster, 0), keys)
        out.append((doc_id, whole, whole * capacity, size, bin_id, held))
    return out


def _pack_tasks(capacity: int):
    """The rows come sorted by ``deal``; one group is held at a time."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

    def packed(deal: int, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = [(*r[:4], (deal << 32) + r[4], r[5]) for r in pack_group(docs, capacity)]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 50_000], strict=True), kinds, strict=True)], [c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs = None, []
        for b in batches:
            for deal, *row in zip(*(b[c].to_pylist() for c in ("deal", "doc_id", "source", "cluster", "length")), strict=True):
                if deal != now and docs:
                    yield from packed(now, docs)
                    docs = []
                now = deal
                docs.append(tuple(row))
        if docs:
            yield from packed(now, docs)

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pack ``rows (doc_id, source, cluster, length)``."""
    rows = stage(rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("cluster").cast("long"), F.col("length").cast("int")), "lengths")
    groups = max(1, ceil(rows.count() / group))
    # the hash takes in every column and a number, so that neither copies nor a crowded source meet in one group
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id", "source", "cluster", "length", F.monotonically_increasing_id()), F.lit(groups)))
    # a task may get several groups; each is packed by itself
    dealt = dealt.repartition(groups, "deal").sortWithinPartitions("deal", "doc_id")
    return dealt.select("deal", "doc_id", "source", "cluster", "length").mapInArrow(released(_pack_tasks(capacity)), PACKED)


def _length_tasks(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, width = encoder(tokenizer_path)
        for batch in batches:
            lengths = [len(encode(t.as_py())) // width + 1 for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["tie"], pa.array(lengths, pa.int32())], ["doc_id", "source", "tie", "length"])

    return run


def document_lengths(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, source, tie, length``: the text's hash and its tokens (without a tokenizer: its words) and an end id."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text).alias("tie"), text.alias("text"))
    if tokenizer_path:
        return rows.mapInArrow(released(_length_tasks(tokenizer_path)), "doc_id long, source string, tie long, length int")
    words = F.array_remove(F.split("text", r"[ \t-\r]+"), "")
    return rows.select("doc_id", "source", "tie", (F.size(words) + 1).alias("length"))


def with_clusters(lengths: DataFrame, docs: DataFrame) -> DataFrame:
    """``lengths`` with ``cluster``: a number of the group of near copies by fingerprint, null for a document of its own.

    Only groups of several documents conflict, so the others don't take part in the join.
    """
    groups = near_rows(docs)
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
    # rows that repeat an id and a text have the same group
    members = groups.join(sizes, "root").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("root").alias("cluster")).distinct()
    return lengths.join(members, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").drop("_id", "_tie")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, tokenizer_path: str | None = None) -> DataFrame:
    """Where every piece of every document goes."""
    return pack(with_clusters(document_lengths(docs, tokenizer_path), docs), capacity, group)
