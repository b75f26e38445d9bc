"""Listwise boosting: regression trees on each list's NDCG-weighted lambdas, with early stop.

Each round computes for every candidate of a list its lambda (the pull of all pairs it is in, each
weighted by what swapping the two would change in NDCG) and the second derivative ``w``.  A tree (:mod:`trees`) splits by
the second-order gain, and a leaf's value is the Newton step ``sum(lambda) / sum(w)``, which ``shrink`` draws towards zero.  Trees are grown on lists of part ``fit`` until the NDCG
of lists of part ``stop`` hasn't risen for ``patience`` rounds; the trees after the best round are dropped.

Rows are bins of a byte a feature with the lists of a task together, kept from round to round, so a round needs no exchange of rows.
Work in a task is one list's positives times its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tallyrec.functions.columns import minmax_within, top_k
from tallyrec.operators.ranking import FEATURES, fit_or_stop, sample_negatives
from tallyrec.operators.trees import Boosted, Tree, added, binned, bytes_of, chunks, edges_of, grow, node_sums
from tallyrec.session import checkpointed, written

#: Rounds of :func:`gain_trees` after which scores are kept, and rows of a list ranker's task.
RESTED, DEALT = 10, 250_000


def discounts(n: int) -> np.ndarray:
    return 1 / np.log2(np.arange(2, n + 2))


def ndcg_of(labels: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int = 10) -> float | None:
    """NDCG at ``k`` with gains ``2 ** label - 1``; None without a positive."""
    gains = 2.0**labels - 1
    ideal = (np.sort(gains)[::-1][:k] * discounts(min(k, len(gains)))).sum()
    if ideal <= 0:
        return None
    order = np.lexsort((ids, -scores))[:k]
    return float((gains[order] * discounts(len(order))).sum() / ideal)


def lambdas(labels: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lambda and second derivative of each candidate of one list."""
    n = len(labels)
    place = np.empty(n, np.int64)
    place[np.lexsort((ids, -scores))] = np.arange(n)
    gains, cost = 2.0**labels - 1, discounts(n)[place]
    ideal = (np.sort(gains)[::-1] * discounts(n)).sum()
    pull, weight = np.zeros(n), np.zeros(n)
    if ideal <= 0:
        return pull, weight
    up = np.flatnonzero(labels > 0)
    better = labels[up][:, None] > labels[None, :]
    change = np.abs((gains[up][:, None] - gains[None, :]) * (cost[up][:, None] - cost[None, :])) / ideal
    wrong = 1 / (1 + np.exp(np.clip(scores[up][:, None] - scores[None, :], -50, 50)))
    first = np.where(better, wrong * change, 0.0)
    second = np.where(better, wrong * (1 - wrong) * change, 0.0)
    pull -= first.sum(0)
    weight += second.sum(0)
    pull[up] += first.sum(1)
    weight[up] += second.sum(1)
    return pull, weight


class Listwise(Boosted):
    """Fitted trees; ``history`` holds the stop part's NDCG after each round."""


def _listed(table: pa.Table) -> dict:
    """A piece's columns by row, with what the rounds add to."""
    users = table["user_id"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], users[1:] != users[:-1]]))
    return {
        "lists": list(zip(starts.tolist(), [*starts[1:].tolist(), len(users)], strict=True)),
        "ids": table["product_id"].to_numpy(),
        "labels": table["label"].to_numpy().astype(float),
        "fit": table["fit"].to_numpy(),
        "bins": bytes_of(table["bins"]),
        "score": np.zeros(len(users)),
    }


def _ndcg_sum(chunk: dict, score: np.ndarray, k: int) -> np.ndarray:
    """Sum and number of the NDCGs of the stop part's lists."""
    found = [ndcg_of(chunk["labels"][s:e], score[s:e], chunk["ids"][s:e], k) for s, e in chunk["lists"] if not chunk["fit"][s]]
    found = [x for x in found if x is not None]
    return np.array([sum(found), len(found)], float)


def _graded(chunk: dict, tree: Tree | None, sampled: float, seed: int, k: int) -> dict:
    """The piece after one more tree: scores, and lambda and weight of the rows that the next tree is grown on."""
    score = chunk["score"] if tree is None else chunk["score"] + tree.value[tree.leaf_of(chunk["bins"])]
    pull, weight = np.zeros(len(score)), np.zeros(len(score))
    for s, e in chunk["lists"]:
        if chunk["fit"][s]:
            pull[s:e], weight[s:e] = lambdas(chunk["labels"][s:e], score[s:e], chunk["ids"][s:e])
    kept = weight > 0
    if sampled < 1:
        kept &= np.random.default_rng([seed, *chunk["at"]]).random(len(score)) < sampled
    rows = np.flatnonzero(kept)
    return chunk | {"score": score, "rows": rows, "pull": pull[rows], "weight": weight[rows], "ndcg": _ndcg_sum(chunk, score, k)}


def _sums(chunk: dict, tree: Tree, slot: np.ndarray, n: int) -> np.ndarray:
    bins = chunk["bins"] if len(chunk["rows"]) == len(chunk["score"]) else chunk["bins"][:, chunk["rows"]]
    return node_sums(bins, chunk["pull"], chunk["weight"], tree, slot, n)


def _dealt(rows: DataFrame, n: int) -> int:
    """Tasks that a pass over ``n`` rows is dealt into."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // DEALT))


def fit(rows: DataFrame, columns=FEATURES, *, rounds: int = 400, patience: int = 40, rate: float = 0.06, depth: int = 6, least_rows: int = 30, sampled: float = 0.85, features_share: float = 0.85, shrink: float = 1.0, k: int = 10, seed: int = 42, negatives: int | None = None) -> Listwise:
    """Trees for ``rows (user_id, product_id, label, columns)``; parts come from a column ``part``, by :func:`fit_or_stop` if there is none.

    With an empty stop part all rounds are run.  ``negatives`` leaves so many of them in a list (:func:`sample_negatives`); they
    are drawn once the features are bins, so that no row of wide columns is exchanged.
    """
    parted = rows if "part" in rows.columns else fit_or_stop(rows, seed=seed)
    x = F.array(*[F.col(c).cast("double") for c in columns])
    state = parted.select(F.col("user_id").cast("long"), F.col("product_id").cast("long"), F.col("label").cast("int"), (F.col("part") == "fit").alias("fit"), x.alias("x"))
    edges = edges_of(state, len(columns))
    small = binned(state, edges)
    small = written(small if negatives is None else sample_negatives(small, negatives), "binned-lists")
    tasks = _dealt(rows, small.count())
    together = checkpointed(small.repartition(tasks, "user_id").sortWithinPartitions("user_id", "product_id"))
    held = chunks(together, _listed, "user_id")
    trees: list[Tree] = []
    history: list[float] = []
    for number in range(rounds + 1):
        last = trees[-1] if trees else None
        graded = held.map(lambda c, last=last, number=number: _graded(c, last, sampled, seed + number, k)).persist(StorageLevel.MEMORY_AND_DISK)
        total = added(graded.map(lambda c: np.append(c["ndcg"], len(c["rows"]))))
        if number:
            held.unpersist()
        held = graded
        if total is None:
            break
        if trees and total[1]:
            history.append(float(total[0] / total[1]))
            if len(history) - 1 - int(np.argmax(history)) >= patience:
                break
        if number == rounds or not total[2]:  # no list has two grades
            break
        ask = lambda tree, slot, n, graded=graded: added(graded.map(lambda c: _sums(c, tree, slot, n)))
        tree = grow(ask, edges, depth=depth, least_rows=least_rows, features_share=features_share, rate=rate, shrink=shrink, seed=seed + number)
        trees.append(tree)
    held.unpersist()
    kept = int(np.argmax(history)) + 1 if history else len(trees)
    return Listwise(trees[:kept], columns, history)


def _gained(table: pa.Table) -> dict:
    return {"bins": bytes_of(table["bins"]), "gain": 2.0 ** table["label"].to_numpy() - 1, "score": np.zeros(len(table))}


def _moved(chunk: dict, fresh: list[Tree]) -> dict:
    return chunk | {"score": sum((t.value[t.leaf_of(chunk["bins"])] for t in fresh), chunk["score"])}


def gain_trees(rows: DataFrame, columns=FEATURES, *, trees: int = 20, depth: int = 5, rate: float = 0.2, least_rows: int = 1, seed: int = 42) -> Boosted:
    """Boosted trees on the gain ``2 ** label - 1`` by squared error: the first tree whole, the others at ``rate`` (a step of 0.1 on twice the residuals).

    The rows are bins in memory (on disk where that is short); scores are kept every ``RESTED`` rounds and what has been grown since is added on the way.
    """
    x = F.array(*[F.col(c).cast("double") for c in columns])
    state = rows.select(F.col("label").cast("int"), x.alias("x"))
    edges = edges_of(state, len(columns))
    held = chunks(binned(state, edges), _gained).persist(StorageLevel.MEMORY_AND_DISK)
    grown: list[Tree] = []
    fresh: list[Tree] = []
    for number in range(trees):

        def ask(tree, slot, n, held=held, fresh=tuple(fresh)):
            def one(chunk):
                return node_sums(chunk["bins"], chunk["gain"] - _moved(chunk, fresh)["score"], None, tree, slot, n)

            return added(held.map(one))

        tree = grow(ask, edges, depth=depth, least_rows=least_rows, features_share=1.0, rate=rate if number else 1.0, shrink=0.0, seed=seed + number)
        if tree is None:
            break
        grown.append(tree)
        fresh.append(tree)
        if len(fresh) == RESTED and number + 1 < trees:
            moved = held.map(lambda c, fresh=tuple(fresh): _moved(c, fresh)).persist(StorageLevel.MEMORY_AND_DISK)
            moved.count()
            held.unpersist()
            held, fresh = moved, []
    held.unpersist()
    return Boosted(grown, columns)


def mean_ndcg(scored: DataFrame, k: int = 10) -> float:
    """Mean NDCG of lists ``user_id, product_id, label, score``."""
    one = lambda f: pd.DataFrame({"v": [ndcg_of(f["label"].to_numpy(float), f["score"].to_numpy(), f["product_id"].to_numpy(), k)]}, dtype=float)
    return scored.groupBy("user_id").applyInPandas(one, "v double").agg(F.avg("v")).first()[0]


def score_pool(model: Boosted, rows: DataFrame, keep: int = 40) -> DataFrame:
    """Scores of a pool, 0 to 1 in each list, the ``keep`` best."""
    scored = model.transform(rows).select("user_id", "product_id", F.col("prediction").alias("score"))
    return top_k(scored.withColumn("score", minmax_within(F.col("score"), ["user_id"])), ["user_id"], "score", "product_id", keep)
