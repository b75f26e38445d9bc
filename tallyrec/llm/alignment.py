"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

A text's tokens by either tokenizer cover the same bytes.  Where tokens of both end,
there is a cut.  An interval is divided at a common end near its middle: ends of A
are tried outwards from the middle, each looked up among B's ends by bisection, and both halves
are divided further.  An interval without a common end inside is a group.  All intervals of a
level are divided at once.

Two tokens are linked if their bytes overlap.  A pair of ids counts once for each document that holds it
linked.  Each document's distinct pairs are written with their multiplicity; the pairs that hold at least ``1 / HEAD`` of
all those counts (so at most ``HEAD`` of them) go to every task with their counts, the others are joined.

Long texts are cut at single spaces between characters that aren't white space: there both tokenizers start a new
token, so groups, links and counts are those of the whole text.

Cases: null and empty texts, and texts of which a tokenizer changes the bytes, have no tokens, zeros and an empty
digest; null ids are documents like others; rows that repeat an id are counted each; an empty table gives an empty
table; further columns are not read; special tokens' strings are plain text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrec.llm.common import stage, text_or_empty
from tallyrec.llm.token_store import BEYOND, CACHE, _latin_units, _Units

#: Characters after which a text is cut, tokens of A that are divided at once, pairs a task counts at once.
PIECE, BLOCK, COUNTED = 1 << 16, 1 << 16, 1 << 21
#: Pairs that are sent to every task with their counts at most (17 bytes each).
HEAD = 1 << 18
SAFE = re.compile(r"(?<=\S) (?=\S)")
SPACE_MARK = "▁"


class ByteTokens:
    """A byte-level tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        rule = spec.get("pre_tokenizer") or {}
        if rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or spec.get("normalizer") is not None:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.size = self.tokenizer.get_vocab_size()
        self.known = _Units(self.tokenizer.model, 4)
        self.units = _latin_units() if rule.get("use_regex", True) else None
        # each character of a byte-level token stands for one byte
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        if self.units is None or BEYOND.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if len(self.known) > CACHE:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.units.findall(text)))


class PieceTokens:
    """A sentencepiece tokenizer that puts a space in front of a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        as_byte = [re.fullmatch("<0x([0-9A-F]{2})>", p) if self.model.is_byte(i) else None for i, p in enumerate(pieces)]
        self.raw = [bytes([int(b[1], 16)]) if b else p.replace(SPACE_MARK, " ").encode() for p, b in zip(pieces, as_byte, strict=True)]
        self.lengths = np.array([len(r) for r in self.raw], np.int64)
        proper = [p for i, p in enumerate(pieces) if not as_byte[i] and not self.model.is_control(i) and not self.model.is_unknown(i)]
        # word characters that a piece joins to others don't count as such
        odd = "".join(sorted({re.escape(c) for p in proper for c in re.findall(rf"[^\W_](?=[^\w{SPACE_MARK}])|(?<=[^\w{SPACE_MARK}])[^\W_]", p)}))
        word = rf"[^\W_{odd}]"
        other = rf"(?:[^\w \n]|[_{odd}])"
        self.units = re.compile(rf" +(?:{word}+|{other}+)?|{word}+|{other}+|\n+")
        # merges make pieces of the vocabulary only: without one that runs across, units are encoded each by itself
        across = re.compile(rf"[^{SPACE_MARK}]{SPACE_MARK}|.\n|\n.|{word}(?!{word}|{SPACE_MARK}|$)|(?<!{word})(?<!{SPACE_MARK})(?<!^){word}", re.DOTALL)
        self.by_unit = not any(map(across.search, proper)) and self._is_plain()
        #: Unit -> its ids; of a unit whose bytes the tokenizer changes, none.
        self.known: dict[str, bytes] = {}

    def _is_plain(self) -> bool:
        """No normalisation, seen on texts that the usual ones change."""
        odd = " a  b \t c\r\n ﬁ Ａé  \n  x "
        return self._bytes(self.model.encode(odd)) == f" {odd}".encode()

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def _learn(self, units: list[str]) -> None:
        """The library puts a space in front of what isn't empty: it takes the place of the unit's own, or stands before a line end, and both are left out again."""
        spaced = [u for u in units if u[0] == " " and len(u) > 1]
        others = [u for u in units if u[0] != " " or len(u) == 1]
        found = self.model.encode([u[1:] for u in spaced], num_threads=1) + [ids[2:] for ids in self.model.encode(["\n" + u for u in others], num_threads=1)]
        for unit, ids in zip(spaced + others, found, strict=True):
            self.known[unit] = array("I", ids).tobytes() if self._bytes(ids) == unit.encode() else b""

    def encode(self, text: str) -> bytes:
        """Ids of a text that starts with a space, as 32-bit integers; fewer bytes than the text's if it changes them."""
        if not self.by_unit:
            ids = self.model.encode(text[1:], num_threads=1)
            return array("I", ids).tobytes() if self._bytes(ids) == text.encode() else b""
        known, units = self.known, self.units.findall(text)
        try:
            return b"".join(map(known.__getitem__, units))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            self._learn(list(set(units).difference(known)))
            return b"".join(map(known.__getitem__, units))


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Which tokens of A end at a cut.

    ``a_ends`` and ``b_ends`` rise over all pieces; ``pieces`` are the last token of A of each piece,
    where B ends too.
    """
    cut = np.zeros(len(a_ends), bool)
    if not len(a_ends):
        return cut
    cut[pieces] = True
    last_b = np.searchsorted(b_ends, a_ends[pieces])
    a_lo, a_hi = np.concatenate([[0], pieces[:-1] + 1]), pieces
    b_lo, b_hi = np.concatenate([[0], last_b[:-1] + 1]), last_b
    while len(a_lo):
        # inner ends are those before the last token of either side
        inner = (a_lo < a_hi) & (b_lo < b_hi)
        a_lo, a_hi, b_lo, b_hi = a_lo[inner], a_hi[inner], b_lo[inner], b_hi[inner]
        middle = (a_lo + a_hi - 1) // 2
        found, other = np.full(len(a_lo), -1), np.zeros(len(a_lo), np.int64)
        open_, away = np.arange(len(a_lo)), 0
        while len(open_):
            for side in (away, -away) if away else (0,):
                at = middle[open_] + side
                fits = (at >= a_lo[open_]) & (at < a_hi[open_])
                mine, at = open_[fits], at[fits]
                place = np.searchsorted(b_ends, a_ends[at])
                hit = (b_ends[place] == a_ends[at]) & (found[mine] < 0)
                found[mine[hit]], other[mine[hit]] = at[hit], place[hit]
            away += 1
            open_ = open_[(found[open_] < 0) & ((middle[open_] - away >= a_lo[open_]) | (middle[open_] + away < a_hi[open_]))]
        split = found >= 0
        at, place = found[split], other[split]
        cut[at] = True
        a_lo, a_hi = np.concatenate([a_lo[split], at + 1]), np.concatenate([at, a_hi[split]])
        b_lo, b_hi = np.concatenate([b_lo[split], place + 1]), np.concatenate([place, b_hi[split]])
    return cut


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in stretches that both tokenizers cut at."""
    at = 0
    while len(text) - at > size:
        safe = SAFE.search(text, at + size)
        if not safe:
            break
        yield text[at : safe.start()]
        at = safe.start()
    yield text[at:]


class Aligner:
    """Both tokenizers and what a worker remembers of them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        # each id's digits with what may follow: more tokens of the side, then the other side
        self.digits = [f"{i}{mark}" for size, marks in ((self.a.size, ",|"), (self.b.size, ",;")) for mark in marks for i in range(size)]

    def align(self, pieces: list[tuple[int, bytes, bytes]]) -> tuple:
        """For pieces ``(document, A's ids, B's ids)``: counts of each piece, its groups as text, and sorted keys ``document * pairs + pair`` with their multiplicity."""
        doc = np.array([p[0] for p in pieces], np.int64)
        a, b = (np.frombuffer(b"".join(p[k] for p in pieces), np.uint32).astype(np.int64) for k in (1, 2))
        n_a, n_b = (np.array([len(p[k]) // 4 for p in pieces], np.int64) for k in (1, 2))
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        cut = shared_cuts(a_ends, b_ends, last_a)
        b_cut = np.zeros(len(b), bool)
        b_cut[np.searchsorted(b_ends, a_ends[cut])] = True
        # groups as text: all of a group's A, then its B
        a_group, b_group = np.cumsum(cut) - cut, np.cumsum(b_cut) - b_cut
        b_before = np.concatenate([[0], np.flatnonzero(b_cut) + 1])
        a_before = np.concatenate([[0], np.flatnonzero(cut) + 1])
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_before[a_group]] = a + cut * self.a.size
        order[np.arange(len(b)) + a_before[b_group + 1]] = b + b_cut * self.b.size + 2 * self.a.size
        bounds = np.concatenate([[0], last_a + last_b + 2]).tolist()
        order = order.tolist()
        texts = ["".join(map(self.digits.__getitem__, order[s:e]))[:-1].encode() for s, e in zip(bounds, bounds[1:], strict=False)]
        groups = np.diff(np.concatenate([[0], np.cumsum(cut)[last_a]]))
        # links: each stretch between neighbouring ends lies in one token of either side
        ends = np.concatenate([a_ends, b_ends])
        ends.sort(kind="stable")
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
        of_a, of_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        pair = a[of_a] * self.b.size + b[of_b]
        keys, times = np.unique(np.repeat(doc, n_a)[of_a] * (self.a.size * self.b.size) + pair, return_counts=True)
        return n_a, n_b, groups, texts, keys, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """A worker's aligner, made once."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


class _Batch:
    """Collects the documents of one Arrow batch, aligned block by block."""

    def __init__(self, own: Aligner, n: int):
        self.own, self.space = own, own.a.size * own.b.size
        self.counts = np.zeros((n, 3), np.int64)
        self.digests: list = [None] * n
        self.good = np.ones(n, bool)
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held: list[tuple[int, bytes, bytes]] = []
        self.size = 0

    def add(self, i: int, text: str) -> None:
        if not text:
            self.good[i] = False
            return
        for piece in pieces_of(" " + text):
            a, b = self.own.a.encode(piece), self.own.b.encode(piece)
            n = len(piece.encode())
            if any(int(side.lengths[np.frombuffer(ids, np.uint32)].sum()) != n for side, ids in ((self.own.a, a), (self.own.b, b))):
                self.good[i] = False
                return
            self.held.append((i, a, b))
            self.size += len(a) // 4
            if self.size >= BLOCK:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        n_a, n_b, groups, texts, keys, times = self.own.align(self.held)
        for (i, _, _), row, text in zip(self.held, np.stack([n_a, n_b, groups], axis=1), texts, strict=True):
            self.counts[i] += row
            if self.digests[i] is None:
                self.digests[i] = hashlib.sha256(text)
            else:
                self.digests[i].update(b";" + text)
        self.keys.append(keys)
        self.times.append(times)
        self.held, self.size = [], 0

    def rows(self, doc_ids: pa.Array) -> pa.RecordBatch:
        self.flush()
        n = len(self.good)
        keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys]), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([np.zeros(0), *self.times]), minlength=len(keys)).astype(np.int64)
        stays = self.good[keys // self.space]
        keys, times = keys[stays], times[stays]
        self.counts[~self.good] = 0
        digests = [d.hexdigest() if good else "" for d, good in zip(self.digests, self.good.tolist(), strict=True)]
        offsets = pa.array(np.searchsorted(keys, np.arange(n + 1) * self.space), pa.int32())
        n_a, n_b, groups = (self.counts[:, k] for k in range(3))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (keys % self.space, times)]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(n_a + n_b - groups), pa.array(digests, pa.string()), *lists], _NAMES)


def _align_tasks(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = aligner(paths)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                got = _Batch(own, len(part))
                for i, text in enumerate(part["text"]):
                    got.add(i, text.as_py())
                yield got.rows(part["doc_id"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts, digest of the groups, distinct linked pairs (``A id * B's size + B id``) and their multiplicity, for every row of ``docs (doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(_align_tasks((a_path, b_path)), ALIGNED)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _count_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair, summed in the task for ``COUNTED`` pairs at a time."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(_flat(batch["pairs"]))
        if sum(map(len, held)) > COUNTED:
            yield out(held)
            held = []
    if held:
        yield out(held)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """``pair, n, best``: in how many documents each pair is linked, and whether no pair of its A id is in more."""
    counts = stage(aligned.select("pairs").mapInArrow(_count_tasks, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.floor(F.col("pair") / b_size).alias("a")
    tops = counts.groupBy(first).agg(F.max("n").alias("top"))  # at most one row for each id of A
    return counts.select("*", first).join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _head_tasks(head):
    """Sums over the pairs of the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = head.value
        for batch in batches:
            place, times = _found(pairs, batch)
            doc = np.repeat(np.arange(len(batch)), np.diff(batch["pairs"].offsets.to_numpy()))
            sums = [np.bincount(doc, weights=w, minlength=len(batch)).astype(np.int64) for w in (np.where(place >= 0, times * best[place], 0), np.where(place >= 0, times * n[place], 0))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("key", *_NAMES[:6])), *map(pa.array, sums)], ["key", *_NAMES[:6], "n_best", "count_sum"])

    return run


def _found(pairs: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Place of each pair in the head or -1, and its multiplicity."""
    codes = _flat(batch["pairs"])
    place = np.searchsorted(pairs, codes)
    return np.where(pairs[place] == codes, place, -1), _flat(batch["times"])


def _tail_tasks(head):
    """Pairs that aren't in the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, times = _found(head.value[0], batch)
            rare = place < 0
            key = np.repeat(batch["key"].to_numpy(), np.diff(batch["pairs"].offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(key[rare]), pa.array(_flat(batch["pairs"])[rare]), pa.array(times[rare])], ["key", "pair", "times"])

    return run


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, *, head: int = HEAD) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``."""
    context = docs.sparkSession.sparkContext
    aligned = stage(align(docs, a_path, b_path).withColumn("key", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(aligned, aligner((a_path, b_path)).b.size), "best-pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # of pairs that hold at least one part in so many there are no more than so many
    top = counts.filter(F.col("n") * head >= max(total, 1)).toPandas().sort_values("pair")
    # ends with what no pair is, so that every search stops within
    sent = context.broadcast((np.append(top["pair"].to_numpy(np.int64), np.iinfo(np.int64).max), np.append(top["n"].to_numpy(np.int64), 0), np.append(top["best"].to_numpy(bool), False)))
    near = aligned.mapInArrow(_head_tasks(sent), "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    rest = aligned.select("key", "pairs", "times").mapInArrow(_tail_tasks(sent), "key long, pair long, times long").join(counts, "pair")
    far = rest.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("far_best"), F.sum(F.col("times") * F.col("n")).alias("far_sum"))
    whole = near.join(far, "key", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("far_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("far_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
