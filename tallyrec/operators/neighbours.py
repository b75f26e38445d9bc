"""Nearest neighbours through an inverted file: lists around k-means centres, of which a query reads the nearest few.

Centres are fitted on a bounded sample (``FIT_ROWS``); every vector is put into the list of its nearest centre.  How
many lists a query reads is measured, not guessed: for ``CALIBRATION`` queries the exact neighbours among all
vectors are found, and so many lists are read as hold the share ``target`` of them.  Vectors without any structure
thus cost most of a full comparison, clustered ones a small part of it.  What is read is scored exactly.

Lists that lie side by side share a group as long as they fill no more than a block (``BLOCK_BYTES``), larger ones are split into
blocks; the queries of a group likewise.  A task compares one block with one block, and of a group only the lists that a query reads, so
a query's vector is exchanged once for a group, not for each of its lists, and no list larger than a block is ever whole in a task.  Equal vectors are searched for once, however many items share one.
Centres (``MAX_LISTS`` of them), the sizes of lists and the calibration queries are all that is sent to the tasks.

Zero vectors are like nothing (score 0); null vectors and ids are left out; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrec.functions.columns import minmax_within, top_k
from tallyrec.operators.content import best_of, once_each, unit
from tallyrec.session import checkpointed

FIT_ROWS, CALIBRATION, MAX_LISTS, BLOCK, TARGET = 20_000, 256, 4096, 2000, 0.95
#: Bytes of vectors that a block holds at most, and queries that are scored at once.
BLOCK_BYTES, STRIP = 32 << 20, 1000
#: Copies of queries that a task forms at once.
ROUTED = 20_000


@dataclass
class Index:
    """``items (id, v, list)`` in their lists, and how to read them."""

    items: DataFrame
    centres: np.ndarray
    #: Vectors of each list.
    sizes: dict[int, int]
    #: How many lists a query reads, and the recall that had at calibration.
    probes: int
    recall: float


def _rows(vectors: DataFrame, item: str) -> DataFrame:
    rows = vectors.select(F.col(item).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v"))
    return rows.filter("id is not null and v is not null")


def _nearness(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Larger is nearer, in Euclidean distance."""
    return v @ centres.T - 0.5 * (centres * centres).sum(1)


def _sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows by a hash of their id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def build(rows: DataFrame, queries: DataFrame | None = None, *, k: int = 10, target: float = TARGET, lists: int | None = None, seed: int = 42) -> Index:
    """An index over ``rows (id, v)`` of vectors of length one, calibrated for the ``k`` nearest of ``queries`` (of the rows themselves)."""
    spark = rows.sparkSession
    n = rows.count()
    wanted = lists or min(MAX_LISTS, max(1, int(np.ceil(np.sqrt(n)))))
    if not n:
        return Index(rows.withColumn("list", F.lit(0)), np.zeros((1, 1)), {}, 1, 1.0)
    sample = checkpointed(_sampled(rows, FIT_ROWS, seed).select(array_to_vector("v").alias("features")))
    fitted = KMeans(k=wanted, maxIter=10, seed=seed, initMode="random").fit(sample) if wanted > 1 else None
    centres = np.stack(fitted.clusterCenters()) if fitted else np.zeros((1, len(rows.first()["v"])))
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for frame in batches:
            near = _nearness(np.stack(frame["v"].to_numpy()), sent.value).argmax(1) if len(frame) else np.zeros(0, int)
            yield frame.assign(list=near)

    items = checkpointed(rows.mapInPandas(assign, "id long, v array<double>, list int"))
    sizes = {r["list"]: r["count"] for r in items.groupBy("list").count().collect()}
    probes, recall = _calibrated(items, centres, _sampled(rows if queries is None else queries, CALIBRATION, seed + 1), k, target, queries is None)
    return Index(items, centres, sizes, probes, recall)


def _calibrated(items: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, target: float, own: bool) -> tuple[int, float]:
    """How many lists hold ``target`` of the queries' exact neighbours, and the share they hold."""
    taken = queries.collect()  # a bounded number
    ids, v = np.array([r["id"] for r in taken], np.int64), np.array([r["v"] for r in taken])
    if not len(ids):
        return len(centres), 1.0
    sent = items.sparkSession.sparkContext.broadcast((ids, v))

    def best(batches):
        ids, v = sent.value
        for frame in batches:
            if not len(frame):
                continue
            scores = v @ np.stack(frame["v"].to_numpy()).T
            if own:
                scores[ids[:, None] == frame["id"].to_numpy()[None, :]] = -np.inf
            at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            found = pd.DataFrame({"query": np.repeat(np.arange(len(ids)), at.shape[1]), "id": frame["id"].to_numpy()[at].ravel(), "list": frame["list"].to_numpy()[at].ravel(), "score": np.take_along_axis(scores, at, 1).ravel()})
            yield found[np.isfinite(found["score"])]

    near = top_k(items.mapInPandas(best, "query long, id long, list int, score double"), ["query"], "score", "id", k).select("query", "list").toPandas()
    place = np.argsort(np.argsort(-_nearness(v, centres), axis=1, kind="stable"), axis=1)
    places = np.sort(place[near["query"].to_numpy(), near["list"].to_numpy()])
    if not len(places):
        return len(centres), 1.0
    probes = int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1
    return probes, float((places < probes).mean())


def block_of(n: int, width: int) -> int:
    """Vectors of a block: as many as ``BLOCK_BYTES`` hold, fewer where that would leave few tasks."""
    return max(BLOCK, min(BLOCK_BYTES // (8 * max(1, width)), n // 8))


def _grouped(sizes: dict[int, int], centres: np.ndarray, block: int) -> np.ndarray:
    """The group of each list, -1 for an empty one: lists that lie side by side share a group as long as they fill no more than a block."""
    about = centres - centres.mean(0)
    along = about @ np.linalg.svd(about, full_matrices=False)[2][0]
    group, at, held = np.full(len(centres), -1), -1, block
    for i in np.argsort(along, kind="stable").tolist():
        n = sizes.get(i, 0)
        if not n:
            continue
        if held + n > block:
            at, held = at + 1, 0
        group[i], held = at, held + n
    return group


def search(index: Index, queries: DataFrame, k: int, *, own: bool, seen: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """``query, id, score, rank``: the ``k`` best of what each of ``queries (id, v)`` reads.

    With ``own`` a query isn't its own neighbour; pairs of ``seen (query, id)`` are left out within the block they are in.
    A query goes once to each group of lists that it reads any of, with a bit for each list of the group.
    """
    spark = queries.sparkSession
    block = block or block_of(sum(index.sizes.values()), index.centres.shape[1])
    group = _grouped(index.sizes, index.centres, block)
    n_groups = int(group.max()) + 1
    place = np.zeros(len(group), np.int64)
    for g in range(n_groups):
        place[group == g] = np.arange((group == g).sum())
    bits = int(place.max()) + 1
    sent, probes = spark.sparkContext.broadcast((index.centres, group, place)), index.probes

    def reads(v):
        """Queries by groups by the groups' lists: whether they are read."""
        centres, group, place = sent.value
        scores = _nearness(np.stack(v), centres)
        near = np.argpartition(-scores, probes - 1, axis=1)[:, :probes] if probes < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))
        out = np.zeros((len(scores), n_groups, bits), bool)
        row, column = np.nonzero(group[near] >= 0)
        out[row, group[near[row, column]], place[near[row, column]]] = True
        return out

    step = max(1, min(ROUTED, 50_000_000 // max(1, n_groups * bits)))

    def count(batches):
        total = np.zeros(n_groups, np.int64)
        for frame in batches:
            for at in range(0, len(frame), step):
                total += reads(frame["v"].to_numpy()[at : at + step]).any(2).sum(0)
        full = np.flatnonzero(total)
        yield pd.DataFrame({"group": full, "n": total[full]})

    def route(batches):
        for frame in batches:
            few = max(1, min(step, ROUTED // max(1, min(probes, n_groups))))  # each copy has its vector
            for at in range(0, len(frame), few):
                some = frame.iloc[at : at + few]
                read = reads(some["v"].to_numpy())
                row, g = np.nonzero(read.any(2))
                packed = np.packbits(read[row, g], axis=1)
                yield pd.DataFrame({"id": some["id"].to_numpy()[row], "v": some["v"].to_numpy()[row], "group": g, "reads": [x.tobytes() for x in packed]})

    asked = {r["group"]: r["n"] for r in queries.mapInPandas(count, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()} if n_groups else {}
    held = {g: sum(index.sizes.get(i, 0) for i in np.flatnonzero(group == g).tolist()) for g in range(n_groups)}
    parts = [(g, max(1, -(-held[g] // block)), max(1, -(-asked.get(g, 0) // block))) for g in range(n_groups)]
    # as many rows as there are groups, and as there are lists
    shape = F.broadcast(spark.createDataFrame(parts or [(0, 1, 1)], "group int, blocks int, query_blocks int"))
    of_list = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group) if g >= 0] or [(0, 0)], "list int, group int"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None)
    placed = index.items.join(of_list, "list").join(shape, "group").withColumn("block", dealt("id", "blocks"))
    items = placed.select("group", "block", each("query_blocks").alias("query_block"), F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("query"), "v", "list", none.cast("binary").alias("reads"))
    asks = queries.mapInPandas(route, "id long, v array<double>, group int, reads binary").join(shape, "group").withColumn("query_block", dealt("id", "query_blocks"))
    asks = asks.select("group", each("blocks").alias("block"), "query_block", F.lit(1).alias("side"), F.lit(0).cast("long").alias("id"), F.col("id").alias("query"), "v", none.cast("int").alias("list"), "reads")
    rows = items.unionByName(asks)
    if seen is not None:
        met = seen.select("query", "id").distinct().join(placed.select("id", "group", "block", "query_blocks"), "id")
        rows = rows.unionByName(met.select("group", "block", dealt("query", "query_blocks").alias("query_block"), F.lit(2).alias("side"), "id", "query", none.cast("array<double>").alias("v"), none.cast("int").alias("list"), none.cast("binary").alias("reads")))

    def best(frame):
        a, b, met = (frame[frame["side"] == side] for side in (1, 0, 2))
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        b = b.sort_values(["list", "id"])
        y, ids, lists = np.stack(b["v"].to_numpy()), b["id"].to_numpy(np.int64), b["list"].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        asked, vectors, read = a["query"].to_numpy(np.int64), a["v"].to_numpy(), a["reads"].to_numpy()
        # pairs that are left out, as places of query and item
        left_row, left_column = pd.Index(asked).get_indexer(met["query"]), pd.Index(ids).get_indexer(met["id"])
        if own:
            left_row, left_column = np.append(left_row, np.arange(len(asked))), np.append(left_column, pd.Index(ids).get_indexer(asked))
        there = (left_row >= 0) & (left_column >= 0)
        left_row, left_column = left_row[there], left_column[there]
        out = []
        for at in range(0, len(asked), STRIP):
            x = np.stack(vectors[at : at + STRIP])
            asks_of = np.unpackbits(np.frombuffer(b"".join(read[at : at + STRIP]), np.uint8).reshape(len(x), -1), axis=1)
            mine = (left_row >= at) & (left_row < at + STRIP)
            row, column = left_row[mine] - at, left_column[mine]
            found = []
            for s, e in zip(starts, np.append(starts[1:], len(ids)), strict=True):
                those = np.flatnonzero(asks_of[:, sent.value[2][lists[s]]])
                if not len(those):
                    continue
                scores = x[those] @ y[s:e].T
                here = (column >= s) & (column < e) & (asks_of[row, sent.value[2][lists[s]]] > 0)
                scores[np.searchsorted(those, row[here]), column[here] - s] = -np.inf
                i, j = best_of(scores, ids[s:e], k)
                found.append((those[i], ids[s + j], scores[i, j]))
            if found:
                r, c, v = (np.concatenate(p) for p in zip(*found, strict=True))
                order = np.lexsort((c, -v, r))
                r, c, v = r[order], c[order], v[order]
                kept = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append(pd.DataFrame({"query": asked[at + r[kept]], "id": c[kept], "score": v[kept]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "score": []})

    found = rows.groupBy("group", "block", "query_block").applyInPandas(best, "query long, id long, score double")
    return top_k(found, ["query"], "score", "id", k)


def similar(vectors: DataFrame, k: int, *, item: str = "product_id", target: float = TARGET, lists: int | None = None, block: int | None = None) -> DataFrame:
    """The ``k`` nearest of each item by cosine, itself excluded: ``item, neighbour, score, rank``; equal vectors are searched for once."""
    rows = _rows(vectors, item).withColumn("v", unit(F.col("v")))

    def found(firsts: DataFrame) -> DataFrame:
        return search(build(firsts, k=k, target=target, lists=lists), firsts, k, own=True, block=block)

    return once_each(rows, k, found)


def recommend(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, *, target: float = TARGET, lists: int | None = None, block: int | None = None) -> DataFrame:
    """Each user's ``k`` items of largest product that aren't seen, scores 0 to 1: ``user_id, product_id, score, rank``.

    One more coordinate makes all items equally long, after which the nearest by cosine are those of largest product.
    """
    of_items = _rows(items, "product_id")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = of_items.agg(F.max(square)).first()[0] or 1.0
    level = F.transform(F.concat("v", F.array(F.sqrt(F.greatest(F.lit(longest) - square, F.lit(0.0))))), lambda x: x / F.lit(float(np.sqrt(longest))))
    asked = _rows(users, "user_id").withColumn("v", F.concat(unit(F.col("v")), F.array(F.lit(0.0))))
    asked = checkpointed(asked)
    index = build(of_items.withColumn("v", level), asked, k=k, target=target, lists=lists)
    pairs = seen.select(F.col("user_id").cast("long").alias("query"), F.col("product_id").cast("long").alias("id"))
    found = search(index, asked, k, own=False, seen=pairs, block=block)
    return found.select(F.col("query").alias("user_id"), F.col("id").alias("product_id"), minmax_within(F.col("score"), ["query"]).alias("score"), "rank")
