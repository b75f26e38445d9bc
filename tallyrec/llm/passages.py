"""Substring dedup: paragraphs, MinHash banding, components.

A paragraph is a line of the text; neighbouring lines of fewer than ``MIN_WORDS`` words are
one paragraph up to the next empty line, and a paragraph of more than ``LONG_WORDS`` words
is also taken in parts, cut by content (``LONG_REACH``).  All paragraphs of at least
``MIN_WORDS`` words (a shorter one is never removed alone) get band keys from MinHash values
over their five-word shingles.  Those that collide are held against each other word by
word: two are similar if the Jaccard similarity of their shingles is ``SIMILARITY`` or
more, or if at most a tenth of the longer one's words has to be edited (``EDITED``), which
is what short paragraphs need, as one word is in five shingles.

Passages that are copied into the middle of other lines are no paragraphs there.  For them each
text is also cut, at any length, where the hash of a word pair is smaller than all
others within ``REACH`` words.  That depends on nearby words only, so the passage comes out
in the same pieces, but for its ragged ends; pieces count if hash and length are equal.

Components of similar paragraphs are clusters.  A cluster
found in two documents or more keeps its first place (smallest document, then
position); runs of other members that together have ``MIN_WORDS`` words are
removed.  What overlaps the kept place is kept with it.

Tasks give spanning links, never all pairs of a bucket.  A bucket of more than
``CROWD`` distinct paragraphs is dealt out again by further MinHash values, several
of them, so that recall stays where it was.  One that is still crowded then is made of
paragraphs that are alike in most shingles; it is dealt out in parts, each with the
bucket's first paragraph, to which the members of all parts are held.

Cases: documents without an id are neither compared nor changed; rows that repeat an
id are one document; null and empty texts have no paragraphs; a document of which
nothing is left is dropped by :func:`remove_repeats`; of equal paragraphs that tie for a place
the smallest document and position is kept; a table without repeats comes back as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.llm.common import drop_staged, released, stage, staged_so_far, tasks_of, text_or_empty
from tallyrec.llm.components import connected_components

#: Words within which a cut is the least: of passages that are copied exactly, and of long paragraphs.
REACH, LONG_REACH = 5, 25
#: Words of a paragraph, or of a run of pieces, that is removed, at least; and of a paragraph that is also cut.
#: A passage of over 50 words has about two whole pieces, its ends being ragged.
MIN_WORDS, LONG_WORDS = 20, 100
SHINGLE, SIMILARITY, EDITED = 5, 0.8, 0.1
#: A key for each of BANDS MinHash values.  1 - (1 - s) ** BANDS of the pairs collide: 99.97 % at a similarity of 0.8, and
#: 93 % at 0.42, which is what is left of five-word shingles when one word in ten is changed.
BANDS = 5
CROWD, EXTRA = 1000, 4
WORDS_HELD = 300_000
#: Words, and rows, that a task turns into arrays or lists at once.
CHUNK_WORDS, CHUNK_ROWS = 100_000, 2000
WORD = re.compile(r"[^ \t-\r]+")

PARAGRAPHS = "doc_id long, start int, n_words int, pid long, keys array<long>"


class _Hashes(dict):
    def __init__(self):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.code = xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.code(word)
        return value

    def of(self, words, n: int) -> np.ndarray:
        if len(self) > WORDS_HELD:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def cuts(h: np.ndarray, reach: int = REACH, firsts: np.ndarray | None = None) -> np.ndarray:
    """Where pieces begin, from the words' hashes; ``firsts`` are the texts' first words, of a single text by default."""
    firsts = np.zeros(1, np.int64) if firsts is None else firsts
    n = len(h)
    if n < 2:
        return firsts
    # texts are set apart by as many places as a word looks at, and the pairs there are never the least
    text = np.zeros(n, np.int64)
    text[firsts[1:]] = 1
    place = np.arange(n) + reach * np.cumsum(text)
    pair = np.full(place[-1] + 1, np.iinfo(np.uint64).max)
    pair[place[:-1]] = mix(h[:-1] * np.uint64(3) + h[1:])
    pair[place[firsts[1:] - 1]] = np.iinfo(np.uint64).max
    least = pair < np.iinfo(np.uint64).max
    for k in range(1, min(reach, len(pair) - 1) + 1):
        least[:-k] &= pair[:-k] < pair[k:]
        least[k:] &= pair[k:] < pair[:-k]
    return np.union1d(firsts, np.flatnonzero(least[place]))


_POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))


def paragraph_hashes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's words in their order."""
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    # beyond 4096 words of one paragraph the powers repeat, mixed with the round
    rounds = mix((place // 4096).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    return mix(np.add.reduceat(mix(h) * _POWERS[place % 4096] * rounds, starts))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the five words from each place on."""
    total = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total = mix(total + h[k : k + len(total)])
    return (total >> np.uint64(32)).astype(np.uint32)


def paragraph_starts(sizes: list[int], at: int = 0) -> list[int]:
    """First words of the paragraphs of a text whose lines have so many words: lines of MIN_WORDS or more, and rows of shorter ones within a block."""
    starts, short = [], False
    for n in sizes:
        if n and not (short and n < MIN_WORDS):
            starts.append(at)
        at, short = at + n, 0 < n < MIN_WORDS
    return starts


def _spans(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and hashes of what the words are cut into."""
    return starts, np.diff(np.append(starts, len(h))), paragraph_hashes(h, starts).view(np.int64)


def _paragraph_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Hashes()

    def block(docs: list[int], h: np.ndarray, firsts: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        """The rows of some texts, whose words stand in one array."""
        lines, pieces = _spans(h, whole), _spans(h, cuts(h, REACH, firsts))
        parts = _spans(h, np.union1d(cuts(h, LONG_REACH, firsts), whole))
        home = np.searchsorted(whole, parts[0], "right") - 1
        # a part that is a whole paragraph is there already
        inner = (lines[1][home] > LONG_WORDS) & (parts[1] < lines[1][home])
        banded = [np.concatenate([x[lines[1] >= MIN_WORDS], y[inner & (parts[1] >= MIN_WORDS)]]) for x, y in zip(lines, parts, strict=True)]
        shingles = shingle_hashes(h)
        sizes = banded[1] - SHINGLE + 1
        edges = np.cumsum(sizes) - sizes
        flat = shingles[np.repeat(banded[0] - edges, sizes) + np.arange(sizes.sum())].view(np.int32) if len(sizes) else shingles[:0]
        keys = band_keys(flat, edges).ravel() if len(sizes) else np.zeros(0, np.int64)
        starts, n_words, pids = (np.concatenate([x, y]) for x, y in zip(banded, pieces, strict=True))
        text = np.searchsorted(firsts, starts, "right") - 1
        # as many keys for each of the first rows, null for the pieces
        offsets = pa.array(np.minimum(np.arange(len(starts) + 1), len(sizes)) * BANDS, pa.int32(), mask=np.append(np.arange(len(starts)) >= len(sizes), False))
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64)[text]), pa.array((starts - firsts[text]).astype(np.int32)), pa.array(n_words.astype(np.int32)), pa.array(pids), lists], ["doc_id", "start", "n_words", "pid", "keys"])

    for batch in _chunks(batches):
        docs, found, firsts, whole, at = [], [], [], [], 0
        for doc_id, cell in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            lines = [line.split() for line in cell.as_py().encode().lower().split(b"\n")]
            sizes = list(map(len, lines))
            n = sum(sizes)
            if not n:
                continue
            found.append(known.of(chain.from_iterable(lines), n))
            docs.append(doc_id), firsts.append(at)
            whole += paragraph_starts(sizes, at)
            at += n
            if at > CHUNK_WORDS:
                yield block(docs, np.concatenate(found), np.array(firsts), np.array(whole))
                docs, found, firsts, whole, at = [], [], [], [], 0
        if docs:
            yield block(docs, np.concatenate(found), np.array(firsts), np.array(whole))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Every paragraph (with its band keys) and every piece (without): document, first word, words, hash."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), text_or_empty())
    return rows.mapInArrow(released(_paragraph_tasks), PARAGRAPHS)


def minhashes(flat: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values of each set."""
    flat = flat.astype(np.int64).astype(np.uint64)
    return np.stack([np.minimum.reduceat(mix(flat * np.uint64(2 * k + 1) + mix(np.uint64([k + 1]))), edges) for k in range(n)], axis=1)


def band_keys(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each set."""
    values = minhashes(flat, edges, BANDS)
    return mix(values + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``CHUNK_ROWS`` rows."""
    for batch in batches:
        for at in range(0, len(batch), CHUNK_ROWS):
            yield batch.slice(at, CHUNK_ROWS)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of an array of lists, where each list begins, and its length."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), offsets[:-1] - offsets[0], np.diff(offsets)


def list_shingles(flat: np.ndarray, edges: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of lists of word codes, in the same form."""
    shingles, sizes = shingle_hashes(flat.astype(np.int64).view(np.uint64)), np.maximum(lengths - SHINGLE + 1, 0)
    begins = np.cumsum(sizes) - sizes
    return shingles[np.repeat(edges - begins, sizes) + np.arange(sizes.sum())] if len(shingles) else shingles, begins, sizes


def _key_tasks(first: int, n: int):
    """``pid, keys`` by the MinHash values from ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            if len(batch):
                shingles, edges, _ = list_shingles(*_flat(batch["words"]))
                keys = mix(minhashes(shingles, edges, first + n)[:, first:] + np.arange(n, dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["pid"], pa.array(list(keys), pa.list_(pa.int64()))], ["pid", "keys"])

    return run


def _word_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Hashes()

    def block(found: list[list[bytes]], pids: list[int]) -> pa.RecordBatch:
        lengths, pids = np.array(list(map(len, found))), np.array(pids)
        h = known.of(chain.from_iterable(found), int(lengths.sum()))
        edges = np.cumsum(lengths) - lengths
        # another row of the same id may have another text
        right = paragraph_hashes(h, edges).view(np.int64) == pids
        words = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(h)), pa.int32()), pa.array(words))
        return pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), lists], ["pid", "words"]).filter(pa.array(right))

    for batch in _chunks(batches):
        pids, found, held = [], [], 0
        for cell, spans in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
            words = cell.as_py().encode().lower().split()
            for span in spans:
                mine = words[span["start"] : span["start"] + span["n_words"]]
                if mine:
                    pids.append(span["pid"]), found.append(mine)
                    held += len(mine)
            if held > CHUNK_WORDS:
                yield block(found, pids)
                pids, found, held = [], [], 0
        if found:
            yield block(found, pids)


def words_again(docs: DataFrame, found: DataFrame, pids: DataFrame) -> DataFrame:
    """``pid, words`` (a code each) of some paragraphs, from one place of each; so words of the others are never stored."""
    places = found.filter("keys is not null").join(pids, "pid", "left_semi").groupBy("pid").agg(F.min(F.struct("doc_id", "start", "n_words")).alias("at"))
    spans = places.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("pid", "at.start", "at.n_words")).alias("spans"))
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), text_or_empty())
    return texts.join(spans, "doc_id").select("text", "spans").mapInArrow(released(_word_tasks), "pid long, words array<int>")


def edit_distance(a: list[int], b: list[int]) -> int:
    """Words to put in, take out or change, by Myers' bit vectors (a bit for each element of ``a``)."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, distance = full, 0, len(a)
    for x in b:
        same = places.get(x, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up = less | ~(across | more) & full
        back = more & across
        distance += bool(up & last) - bool(back & last)
        up, back = (up << 1 | 1) & full, back << 1 & full
        more, less = (back | ~(down | up)) & full, up & down
    return distance


def bucket_links(words: list[list[int]], sets: list[set[int]], similarity: float, edited: float) -> list[tuple[int, int]]:
    """Links that span the groups of similar paragraphs of a bucket."""

    counts, lengths, kinds = list(map(len, sets)), list(map(len, words)), {}

    def similar(i: int, j: int) -> bool:
        small, large = sorted((counts[i], counts[j]))
        edits = int(edited * max(lengths[i], lengths[j]))
        close = abs(lengths[i] - lengths[j]) <= edits
        if not close and small < similarity * large:
            return False
        shared = len(sets[i] & sets[j])
        if shared >= similarity * (small + large - shared):
            return True
        # an edit takes at most SHINGLE shingles from either side, and one kind of word
        if not close or shared < large - SHINGLE * edits:
            return False
        # words changed in their places are the common case, and cheaper to count
        if lengths[i] == lengths[j] and sum(map(ne, words[i], words[j])) <= edits:
            return True
        for k in (i, j):
            if k not in kinds:
                kinds[k] = set(words[k])
        if len(kinds[i] - kinds[j]) > edits or len(kinds[j] - kinds[i]) > edits:
            return False
        return edit_distance(words[i], words[j]) <= edits

    groups: list[list[int]] = []
    links = []
    for i in range(len(words)):
        mine, apart = [i], []
        for group in groups:
            met = next((j for j in group if similar(i, j)), None)
            if met is None:
                apart.append(group)
            else:
                links.append((i, met))
                mine = group + mine
        groups = [*apart, mine]
    return links


def _verify_tasks(similarity: float, edited: float):
    """The rows come sorted by key; one bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pids, words, sets, found = None, [], [], [], []

        def close():
            if len(pids) > 1:
                found.extend((pids[i], pids[j]) for i, j in bucket_links(words, sets, similarity, edited))

        for batch in _chunks(batches):
            flat, edges, lengths = _flat(batch["words"])
            shingles, begins, sizes = list_shingles(flat, edges, lengths)
            codes, shingles = flat.tolist(), shingles.tolist()
            for k, pid, at, n, first, size in zip(batch["key"].to_pylist(), batch["pid"].to_pylist(), edges.tolist(), lengths.tolist(), begins.tolist(), sizes.tolist(), strict=True):
                if k != key:
                    close()
                    key, pids, words, sets = k, [], [], []
                pids.append(pid), words.append(codes[at : at + n]), sets.append(set(shingles[first : first + size]))
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found.clear()
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def _counted(keyed: DataFrame) -> DataFrame:
    """``key, pid, members`` of keys that several paragraphs have; of keys with the same members only one."""
    # both sides of the join read the same exchange
    keyed = keyed.repartition("key")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("pid")).alias("mix"), F.min("pid").alias("lo"), F.max("pid").alias("hi")).filter("members > 1")
    one = sizes.groupBy("members", "mix", "lo", "hi").agg(F.min("key").alias("key")).select("key", "members")
    return keyed.join(one, "key").select("key", "pid", "members")


def band_links(banded: DataFrame, words_of, similarity: float, edited: float, crowd: int) -> DataFrame:
    """Links from ``banded (pid, keys)``; ``words_of`` gives the words of paragraphs that share a key with another."""
    tasks = tasks_of(banded.sparkSession)
    # a paragraph has its keys once, however often it stands in the texts; equal ones are combined in each task
    once = banded.groupBy("pid").agg(*[F.max(F.col("keys")[k]).alias(f"k{k}") for k in range(BANDS)])
    keyed = once.select("pid", F.explode(F.array(*[f"k{k}" for k in range(BANDS)])).alias("key"))
    met = stage(_counted(keyed), "bands")
    words = words_of(met.select("pid").distinct())
    crowded = met.filter(F.col("members") > crowd)
    dealt = met.filter(F.col("members") <= crowd).select("key", "pid")
    if crowded.limit(1).count():
        words = stage(words, "paragraph-words")
        finer = words.join(crowded.select("pid").distinct(), "pid", "left_semi").mapInArrow(released(_key_tasks(BANDS, EXTRA)), "pid long, keys array<long>")
        again = crowded.join(finer, "pid").select("pid", F.col("key").alias("whole"), F.explode("keys").alias("key")).select("pid", F.xxhash64("whole", "key").alias("key"))
        again = stage(_counted(again.distinct()), "finer-bands")
        dealt = dealt.unionByName(again.filter(F.col("members") <= crowd).select("key", "pid"))
        still = again.filter(F.col("members") > crowd).withColumn("parts", F.ceil(F.col("members") / crowd).cast("long"))
        part = still.select(F.xxhash64("key", F.pmod(F.xxhash64("pid"), F.col("parts"))).alias("key"), "pid")
        firsts = still.groupBy("key", "parts").agg(F.min("pid").alias("pid")).select("key", "pid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        dealt = dealt.unionByName(part.unionByName(firsts.select(F.xxhash64("key", "part").alias("key"), "pid")).distinct())
    return dealt.join(words, "pid").repartition(tasks, "key").sortWithinPartitions("key", "pid").mapInArrow(released(_verify_tasks(similarity, edited)), "a long, b long")


def near_links(found: DataFrame, similarity: float = SIMILARITY, edited: float = EDITED, crowd: int = CROWD) -> DataFrame:
    """Spanning links ``a, b`` between similar distinct paragraphs ``found (pid, words)``; words are codes, ``SHINGLE`` of them at least."""
    return band_links(found.mapInArrow(released(_key_tasks(0, BANDS)), "pid long, keys array<long>"), lambda pids: found.join(pids, "pid", "left_semi"), similarity, edited, crowd)


RUNS = ["doc_id", "start_word", "n_words", "cluster_id", "keeper_doc_id", "removed"]


def repeated_runs(docs: DataFrame, *, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, edited: float = EDITED, crowd: int = CROWD) -> DataFrame:
    """Runs of repeated paragraphs: one row for each place, the kept one included."""
    mark = staged_so_far()
    found = stage(paragraphs(docs), "paragraphs")
    links = band_links(found.filter("keys is not null").select("pid", "keys"), lambda pids: words_again(docs, found, pids), similarity, edited, crowd)
    roots = connected_components(links)
    # clusters of several paragraphs, and paragraphs in several places; the counts are combined in each task, so a common line is no heavy key
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("pid"), F.col("root").alias("cluster_id"))
    common = found.groupBy("pid").agg(F.count("*").alias("n")).filter("n > 1").select("pid")
    wanted = linked.unionByName(common.join(linked, "pid", "left_anti").select("pid", F.col("pid").alias("cluster_id")))
    places = stage(found.select("doc_id", "start", "n_words", "pid").join(wanted, "pid").select("doc_id", "start", "n_words", "cluster_id").distinct(), "places")
    drop_staged(docs.sparkSession, mark, keep=(places,))
    first = F.min(F.struct("doc_id", "start", "n_words"))
    groups = places.groupBy("cluster_id").agg(first.alias("first"), F.max("doc_id").alias("last_doc")).filter("first.doc_id <> last_doc")
    groups = groups.select("cluster_id", F.col("first.doc_id").alias("keeper_doc_id"), (F.col("first.start") + F.col("first.n_words")).alias("keeper_end"))
    met = places.join(groups, "cluster_id").withColumn("removed", (F.col("doc_id") != F.col("keeper_doc_id")) | (F.col("start") >= F.col("keeper_end")))
    # pieces of different cuts overlap: a run goes on while the next one begins no later than any before has ended
    met = met.withColumn("end", F.col("start") + F.col("n_words"))
    by_doc = W.partitionBy("doc_id", "removed").orderBy("start", "end", "cluster_id")
    reached = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    runs = met.withColumn("breaks", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("run", F.sum("breaks").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    start = F.min("start")
    rows = runs.groupBy("doc_id", "removed", "run").agg(start.alias("start_word"), (F.max("end") - start).cast("int").alias("n_words"), F.min_by("cluster_id", F.struct("start", "cluster_id")).alias("cluster_id"), F.min("keeper_doc_id").alias("keeper_doc_id"))
    return rows.filter(F.col("n_words") >= min_words).select(*RUNS)


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of ``runs (first word, words)`` and the white space after them."""
    if not runs:
        return text
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    keep, upto = [], 0
    for start, n in sorted(runs):
        keep.append(text[upto : at[min(start, len(at) - 1)]])
        upto = at[min(start + n, len(at) - 1)]
    return "".join([*keep, text[upto:]])


def _cut(text: Column, runs: Column) -> Column:
    @F.pandas_udf("string")
    def cut(texts, lists):
        import pandas as pd

        return pd.Series([None if t is None else cut_words(t, [(r["start_word"], r["n_words"]) for r in found]) for t, found in zip(texts, lists, strict=True)], dtype=object)

    return cut(text, runs)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the repeated runs; ``n_chars``, if there, follows the text.

    Rows of one id that have different texts aren't cut, as the runs are found by id.
    """
    runs = repeated_runs(docs, **options).filter("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("_runs"))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    unclear = docs.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).filter("lo <> hi").select("doc_id")
    runs = stage(runs.join(unclear, "doc_id", "left_anti"), "removed-runs")
    # both sides are exchanged at any size, once; only texts with runs pass through Python
    joined = docs.join(runs.hint("merge"), "doc_id", "left")
    met = F.col("_runs").isNotNull() & F.col("text").isNotNull()
    changed = joined.withColumn("_rest", _cut(F.when(met, F.col("text")), F.col("_runs"))).withColumn("_met", met)
    changed = changed.filter(~F.col("_met") | F.col("_rest").rlike(r"[^ \t-\r]")).withColumn("text", F.when(F.col("_met"), F.col("_rest")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_met"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
