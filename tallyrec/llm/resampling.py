"""Importance resampling towards a target's distribution of hashed word runs.

Features are all runs of one to three words; a feature's bucket is the CRC-32 of its
bytes modulo ``BUCKETS``.  A bucket's gain is the log ratio of its share in the target to
its share in the documents; a document's weight is the sum over its features.  Weights plus
Gumbel noise from a hash of the id rank the documents, and the highest are drawn.

Words follow a head-tail split.  The head holds the words that make up at least ``1 / HEAD_WORDS`` of the corpus with the CRC state
after each of them, and the pairs of such words that make up ``1 / HEAD_PAIRS`` with state and bucket; both are therefore
bounded in number and bytes, and sent to every task.  All else is the tail: its CRC is computed from
its own bytes, and runs extend the state of what stands before the last word.  Head and tail give
the same buckets (the head only saves work), so totals and weights are exact for any head.
Word counts for the head cover all documents.  Pair counts keep, of each stretch of words, the pairs that make up
more than ``1 / HEAVY`` of it, so a pair with twice that share of the corpus can't be missed.

Cases: null and empty texts, and texts without a word, have no features and weight zero; null ids draw their
noise from an empty id and come last among equal scores; repeated rows are ranked each; an empty table gives an
empty table, an empty target is a target without features; further columns are not read; texts are cut into
stretches of a megabyte, with the last two words carried over.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.llm.common import stage, tasks_of

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 42, 20, 5
#: Words and pairs of the head at most, and the longest word it takes, in bytes: with these it has at most 4 + 17 MB.
HEAD_WORDS, HEAD_PAIRS, LONGEST = 65_535, 131_072, 64
#: Words of a block, bytes of a stretch, distinct words a task counts at once, share of a block that makes a pair heavy.
BLOCK, STRETCH, COUNTED, HEAVY = 1 << 17, 1 << 20, 300_000, 1 << 15
SLOTS = 1 << 20
#: Lower-cases A-Z, keeps digits, a-z and what isn't ASCII, and turns all else to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _crc_bytes() -> np.ndarray:
    """CRC-32 of each byte's value by the polynomial's rule."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def _shifts() -> np.ndarray:
    """What ``n`` zero bytes make of a state, for each of its four bytes, ``n`` up to ``LONGEST``."""
    step = _crc_bytes()
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(LONGEST):
        now = (now >> 8) ^ step[now & 255]
        out.append(now)
    return np.concatenate([x.ravel() for x in out])


_SHIFTS = _shifts()
_SPACE = np.uint32(zlib.crc32(b" "))


def extended(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of ``left``'s bytes followed by ``right``'s, which are ``size`` (up to ``LONGEST``)."""
    at = size * 1024
    out = right ^ _SHIFTS[at + (left & 255)]
    for k in (1, 2, 3):
        out ^= _SHIFTS[at + 256 * k + ((left >> (8 * k)) & 255)]
    return out


def _spaced(state: np.ndarray) -> np.ndarray:
    return extended(state, np.full(len(state), _SPACE), np.ones(len(state), np.int64))


class Head:
    """Frequent words with their CRC states, frequent pairs with states and buckets."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        place = {w: i for i, w in enumerate(words)}
        self.words, self.pairs = words, np.array([place[a] << 16 | place[b] for a, b in pairs if a in place and b in place], np.uint32)

    @cached_property
    def tables(self) -> tuple:
        """Made once in each worker: place of a word, words' states and lengths, pairs by slot."""
        states = np.array([zlib.crc32(w) for w in self.words] + [0], np.uint32)
        sizes = np.array([len(w) for w in self.words] + [0], np.int64)
        codes, after, buckets = np.full(SLOTS, 0xFFFFFFFF, np.uint32), np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint16)
        pairs = self.pairs[::-1]  # of pairs that share a slot the most frequent one stays
        slots = self.slot(pairs)
        codes[slots] = pairs
        a, b = (pairs >> 16).astype(np.int64), (pairs & 0xFFFF).astype(np.int64)
        after[slots] = extended(_spaced(states[a]), states[b], sizes[b])
        buckets[slots] = after[slots] % BUCKETS
        return {w: i for i, w in enumerate(self.words)}, states, sizes, codes, after, buckets

    @staticmethod
    def slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(12)

    def features(self, words: list[bytes], doc: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the runs that end in words from ``old`` on, and the document of each."""
        places, states, sizes, pair_codes, pair_states, pair_buckets = self.tables
        n = len(words)
        place = np.fromiter(map(places.get, words, repeat(-1)), np.int64, n)
        state, size = states[place], sizes[place]
        tail = np.flatnonzero(place < 0)
        state[tail] = np.fromiter((zlib.crc32(words[i]) for i in tail.tolist()), np.uint32, len(tail))
        size[tail] = np.fromiter((len(words[i]) for i in tail.tolist()), np.int64, len(tail))
        far = np.flatnonzero(size > LONGEST)
        size[far] = 0

        def runs(left: np.ndarray, ends: np.ndarray) -> np.ndarray:
            out = extended(left, state[ends], size[ends])
            if len(far):
                for k in np.flatnonzero(np.isin(ends, far)).tolist():
                    out[k] = zlib.crc32(words[ends[k]], int(left[k]))
            return out

        two = np.flatnonzero(doc[1:] == doc[:-1]) + 1 if n else np.zeros(0, np.int64)
        known = (place[two - 1] >= 0) & (place[two] >= 0)
        code = (np.where(known, place[two - 1], 0).astype(np.uint32) << np.uint32(16)) | np.where(known, place[two], 0).astype(np.uint32)
        slot = self.slot(code)
        hit = known & (pair_codes[slot] == code)
        after = np.empty(len(two), np.uint32)
        after[hit] = pair_states[slot[hit]]
        after[~hit] = runs(_spaced(state[two[~hit] - 1]), two[~hit])
        bucket = after % BUCKETS
        bucket[hit] = pair_buckets[slot[hit]]
        whole = np.full(n, -1, np.int64)  # where the pair that ends in a word stands
        whole[two] = np.arange(len(two))
        three = two[whole[two - 1] >= 0]
        last = runs(_spaced(after[whole[three - 1]]), three) % BUCKETS
        one, new2, new3 = np.arange(old, n), two >= old, three >= old
        return np.concatenate([state[old:] % BUCKETS, bucket[new2], last[new3]]).astype(np.int64), np.concatenate([doc[one], doc[two[new2]], doc[three[new3]]])


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, stretch by stretch."""
    text, at = text.translate(FOLD), 0
    while len(text) - at > STRETCH:
        cut = text.rfind(b" ", at + 1, at + STRETCH)
        cut = text.find(b" ", at + STRETCH) if cut < 0 else cut
        if cut < 0:
            break
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def word_blocks(texts: Iterable[bytes], size: int = BLOCK) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(words, number of each word's text, how many words at the front were in the block before)."""
    words: list[bytes] = []
    docs: list[int] = []
    counts: list[int] = []
    old = 0
    for i, text in enumerate(texts):
        for found in _stretches(text):
            words += found
            docs.append(i)
            counts.append(len(found))
            if len(words) >= size:
                doc = np.repeat(docs, counts)
                yield words, doc, old
                words, docs = words[-2:], doc[-2:].tolist()
                counts, old = [1] * len(docs), len(docs)
    if len(words) > old:
        yield words, np.repeat(docs, counts), old


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() for t in batch["text"])


_COUNTS = pa.schema([("word", pa.binary()), ("next", pa.binary()), ("n", pa.int64())])


def _count_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of pairs that are heavy in their block."""
    seen: Counter[bytes] = Counter()

    def out(keys: list[bytes], then: list[bytes | None], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(then, pa.binary()), pa.array(n, pa.int64())], schema=_COUNTS)

    for batch in batches:
        for words, doc, old in word_blocks(_texts(batch)):
            seen.update(words[old:])
            local: dict[bytes, int] = {}
            code = np.fromiter((local.setdefault(w, len(local)) for w in words), np.int64, len(words))
            same = doc[1:] == doc[:-1]
            if old:
                same[: old - 1] = False
            pairs, times = np.unique(code[:-1][same] << 32 | code[1:][same], return_counts=True)
            heavy = times > max(1, len(words) // HEAVY)
            names = list(local)
            yield out([names[p >> 32] for p in pairs[heavy].tolist()], [names[p & 0xFFFFFFFF] for p in pairs[heavy].tolist()], times[heavy].tolist())
            if len(seen) > COUNTED:
                yield out(list(seen), [None] * len(seen), list(seen.values()))
                seen.clear()
    if seen:
        yield out(list(seen), [None] * len(seen), list(seen.values()))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def learn_head(rows: DataFrame, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """The head of ``rows (text binary)``; what comes to the driver is bounded by number and by length."""
    short = (F.length("word") <= LONGEST) & (F.coalesce(F.length("next"), F.lit(0)) <= LONGEST)
    counts = stage(rows.select("text").mapInArrow(_count_tasks, "word binary, next binary, n long").filter(short).groupBy("word", "next").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.filter("next is null").agg(F.sum("n")).first()[0] or 0
    # of what holds at least one part in so many there are no more than so many
    above = lambda kind, most: sorted(counts.filter(kind).filter(F.col("n") * most >= total).collect() if most else [], key=lambda r: (-r["n"], r["word"], r["next"] or b""))
    top, heavy = above("next is null", words), above("next is not null", pairs)
    return Head([bytes(r["word"]) for r in top], [(bytes(r["word"]), bytes(r["next"])) for r in heavy])


def bucket_totals(rows: DataFrame, head) -> np.ndarray:
    """How many features of ``rows (text binary)`` fall into each bucket; each task sends its own sums."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words, doc, old in word_blocks(_texts(batch)):
                total += np.bincount(head.value.features(words, doc, old)[0], minlength=BUCKETS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(tasks, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    out[[r["bucket"] for r in found]] = [r["n"] for r in found]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket: thousandths of the log ratio, rounded down."""
    s_all, t_all = int(source.sum()) + len(source), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log(((t + 1) * s_all) / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(rows: DataFrame, head, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of ``rows (doc_id, text binary)``."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for words, doc, old in word_blocks(_texts(batch)):
                bucket, owner = head.value.features(words, doc, old)
                n_words += np.bincount(doc[old:], minlength=n)
                n_features += np.bincount(owner, minlength=n)
                first = int(owner.min())
                part = np.bincount(owner - first, weights=gain[bucket]).astype(np.int64)
                weight[first : first + len(part)] += part
            score = weight + np.fromiter((noise(d, seed) for d in batch["doc_id"].to_pylist()), np.int64, n)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, (n_words, n_features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(tasks, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with the rank of what is drawn.

    Rows are dealt out by ranges of their order; a rank is the row's place in its range
    plus the sizes of the ranges before, of which there is one number a task.
    """
    eligible = F.col("n_words") >= least_words
    quota = scored.filter(eligible).count() * percent // 100
    order = [F.when(eligible, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = scored.repartitionByRange(tasks_of(scored.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stage(placed.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")).drop("at"), "ranges")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row a task
    rank = F.col("before") + F.col("place") + 1
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.when(eligible & (rank <= quota), rank)).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``, towards ``target (text)``."""
    rows, context = _rows(docs), docs.sparkSession.sparkContext
    head = context.broadcast(learn_head(rows, head_words, head_pairs))
    wanted = target.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    gain = gains(bucket_totals(rows, head), bucket_totals(wanted, head))
    scored = stage(weigh(rows, head, gain, seed), "scores")
    return ranked(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
