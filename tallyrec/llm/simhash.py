"""SimHash fingerprints, linked by a self-join of binary tries.

Fingerprints at most ``budget`` bits apart are linked.  Two such fingerprints agree
on one of ``budget + 1`` blocks of their bits, so each distinct fingerprint is dealt
out once for each block, by that block's value.  Inside a task a trie over the other
bits is joined with itself: pairs of nodes are walked together from the root, the bits
in which they differ are counted, and a pair is dropped once that exceeds the budget.

What is wanted are the components, so a task returns a spanning forest, never all
pairs: a pair of nodes whose leaves already hang together is not opened any more.
Blocks shared by more than ``hot`` distinct fingerprints are dealt out again by
the blocks of the remaining bits, which keeps every link and splits the group.

Cases: null and empty texts have fingerprint zero and are linked like any other;
null ids are fingerprinted and linked, but never name a component that has an id;
repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrec.llm.common import released, stage, tasks_of, text_or_empty
from tallyrec.llm.components import connected_components

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Distinct fingerprints that may share a block's value before it is split.
HOT = 50_000
#: Node pairs that a task holds at once.
CHUNK = 1 << 19


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text, as unsigned."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(SHINGLE)), strict=False))
    hashes = map(xxh64_intdigest, shingles, repeat(SEED))
    n = len(words) - SHINGLE + 1
    over = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        codes = np.fromiter(hashes, np.uint64, min(1 << 16, n - at)).astype(">u8")
        over += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > n).tobytes(), "big")


def _fingerprint_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], pa.array(codes.view(np.int64))], ["doc_id", "tie", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, tie, fp``: the text's hash, and the 64 bits, read as signed."""
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty())
    return rows.withColumn("tie", F.xxhash64("text")).mapInArrow(released(_fingerprint_tasks), "doc_id long, tie long, fp long")


def blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """``n`` blocks (offset from the top, width) that cover ``bits`` bits."""
    edges = [round(i * bits / n) for i in range(n + 1)]
    return list(zip(edges, np.diff(edges).tolist(), strict=False))


def to_front(codes: np.ndarray, at: int, width: int) -> np.ndarray:
    """Move a block of bits to the top, keeping the order of the others."""
    if at == 0:
        return codes
    u = np.uint64
    mine = (codes >> u(64 - at - width)) & u((1 << width) - 1)
    above = codes >> u(64 - at)
    below = codes & u((1 << (64 - at - width)) - 1)
    return (mine << u(64 - width)) | (above << u(64 - width - at)) | below


def _merge(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Group labels after the links i-j; a group's label is its smallest index."""
    while True:
        a, b = group[i], group[j]
        apart = a != b
        if not apart.any():
            return group
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        up = np.arange(len(group))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (nxt := up[up]).tobytes() != up.tobytes():
            up = nxt
        group = up[group]


def trie_groups(codes: np.ndarray, fixed: int, budget: int = BUDGET, chunk: int = CHUNK) -> np.ndarray:
    """Group labels of sorted distinct ``codes`` under links within ``budget`` bits.

    Only codes that agree on the top ``fixed`` bits are compared.
    """
    n = len(codes)
    group = np.arange(n)
    if n < 2:
        return group
    top = codes >> np.uint64(64 - fixed) if fixed else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    hi = np.concatenate([lo[1:], [n]])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    ones: dict[int, np.ndarray] = {}
    work = [(fixed, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while work:
        depth, a, b, c, d, off = work.pop()
        if len(a) > chunk:
            order = np.argsort(off, kind="stable")
            near, far = order[: len(a) // 2], order[len(a) // 2 :]
            work += [(depth, a[far], b[far], c[far], d[far], off[far]), (depth, a[near], b[near], c[near], d[near], off[near])]
            continue
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            i, j = a[single], c[single]
            close = np.bitwise_count(codes[i] ^ codes[j]) <= budget
            group = _merge(group, i[close], j[close])
        steps = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
        joined = (steps[b - 1] == steps[a]) & (steps[d - 1] == steps[c]) & (group[a] == group[c])
        left = ~(single | joined)
        a, b, c, d, off = a[left], b[left], c[left], d[left], off[left]
        if not len(a) or depth == 64:
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((codes >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        count = ones[depth]
        m, k = b - (count[b] - count[a]), d - (count[d] - count[c])
        own = (a == c) & (b == d)
        # children: 0-0, 1-1, 0-1 and, for two different nodes, 1-0
        kids = [(a, m, c, k, off), (m, b, k, d, off), (a, m, k, d, off + 1), (m[~own], b[~own], c[~own], k[~own], off[~own] + 1)]
        a, b, c, d, off = (np.concatenate(x) for x in zip(*kids, strict=True))
        keep = (a < b) & (c < d) & (off <= budget) & ~((a == c) & (b - a == 1) & (d - c == 1))
        work.append((depth + 1, a[keep], b[keep], c[keep], d[keep], off[keep]))
    return group


def _link_tasks(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        codes = table["fp"].to_numpy().view(np.uint64)
        first, second = table["block"].to_numpy(), table["sub"].to_numpy()
        outer = blocks(64, budget + 1)
        for one in np.unique(first):
            at, width = outer[one]
            inner = blocks(64 - width, budget + 1)
            for two in np.unique(second[first == one]):
                mine = codes[(first == one) & (second == two)]
                turned, fixed = to_front(mine, at, width), width
                if two >= 0:
                    # the block found first stays on top; the second one follows it
                    head = turned & ~np.uint64((1 << (64 - width)) - 1)
                    tail = to_front(turned << np.uint64(width), *inner[two])
                    turned, fixed = head | tail >> np.uint64(width), width + inner[two][1]
                turned, back = np.unique(turned, return_index=True)
                group = trie_groups(turned, fixed, budget)
                moved = np.flatnonzero(group != np.arange(len(group)))
                if len(moved):
                    source = mine[back].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(source[moved]), pa.array(source[group[moved]])], ["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that span the components."""
    cut = lambda at, width: F.shiftrightunsigned("fp", 64 - at - width).bitwiseAND(F.lit((1 << width) - 1))
    keyed = [F.struct(F.lit(i).alias("block"), cut(*spec).alias("key")) for i, spec in enumerate(blocks(64, budget + 1))]
    dealt = distinct.select("fp", F.inline(F.array(*keyed)))
    crowded = dealt.groupBy("block", "key").count().filter(F.col("count") > hot).select("block", "key", F.lit(True).alias("hot"))
    dealt = dealt.join(crowded, ["block", "key"], "left")

    def subs(i: int):
        # blocks of what is left once block i is taken out, read off the bits in their order
        at, width = blocks(64, budget + 1)[i]
        turned = F.shiftleft("fp", width) if i == 0 else F.shiftleft(F.shiftrightunsigned("fp", 64 - at), 64 - at).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(F.lit((1 << (64 - at - width)) - 1)), width))
        rest = [F.struct(F.lit(j).alias("sub"), F.shiftrightunsigned(turned, 64 - b - w).bitwiseAND(F.lit((1 << w) - 1)).alias("rest")) for j, (b, w) in enumerate(blocks(64 - width, budget + 1))]
        return F.array(*rest)

    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest")))
    chosen = whole
    for i in range(budget + 1):
        chosen = F.when(F.col("hot") & (F.col("block") == i), subs(i)).otherwise(chosen)
    spread = dealt.select("fp", "block", "key", F.inline(chosen)).repartition(tasks_of(distinct.sparkSession), "block", "key", "sub", "rest")
    return spread.select("fp", "block", "sub").mapInArrow(released(_link_tasks(budget)), "a long, b long")


def near_rows(docs: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """``doc_id, tie, fp, root, component_id`` of every document: ``tie`` is the text's hash, ``root`` the group's smallest fingerprint."""
    prints = stage(fingerprints(docs), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    found = connected_components(fingerprint_links(distinct, budget, hot))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    # Written first, so that the join below exchanges both sides and a crowded fingerprint can be split.
    named = stage(rooted.join(names, "root").select("fp", "root", "component_id"), "named-fingerprints")
    return prints.join(named, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def near_groups(docs: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    return near_rows(docs, budget, hot).select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
