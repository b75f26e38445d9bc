"""Regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of transformed statistics; the covariance is
shrunk towards the pooled one and then towards its own diagonal.  A document's
score is the logistic of the difference of the two Mahalanobis log-densities (plus
the log prior odds), computed by products with the cached inverses of the Cholesky factors.

The moments are sums that Spark adds over all labelled rows of the training folds, first for the
means and then for the products of what is left of them (so no digits are lost however many
rows there are); the driver sees two rows each time.

Cases: null and empty texts have all-zero statistics and get a score like others;
a document labelled twice counts as good only if every label says so; null labels
are passed over; with labels of one class or none, every score is that class's
share (0.5 without any); a score of just the threshold counts as good; repeated rows get
the same score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyrec.llm.common import released, stage, text_or_empty
from tallyrec.llm.quality_rules import SYMBOLS, char_classes

STATISTICS = ("words", "word_length", "distinct", "upper", "symbol", "point", "digit", "top_word", "adjacent", "shout", "marked", "short", "dup_lines", "line_words", "wide", "capital")
SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
#: Log-density differences are divided by this before the logistic, as the statistics aren't normal.
TEMPERATURE = 20.0
FOLDS = 5
COLUMNS = [f"f{i}" for i in range(len(STATISTICS))]
FEATURES = "doc_id long, tie long, " + ", ".join(f"{c} double" for c in COLUMNS)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    seen = Counter(words)
    lower, upper, accented, other, _, digit, point, symbol, _, _ = char_classes(text).tolist()
    wide = accented + other
    chars = max(1, len(text))
    letters = max(1, lower + upper + wide)
    lines = [line for line in text.split("\n") if line.strip()]
    marks = tuple(SYMBOLS.encode()[i : i + 1] for i in range(len(SYMBOLS)))
    root = lambda x: x**0.5
    return [
        np.log1p(n),
        np.log1p(letters / n),
        np.log(len(seen) / n) / np.log(n + 2),
        root(upper / letters),
        root(symbol / chars),
        root(point / chars),
        root(digit / chars),
        root(max(seen.values()) / n),
        root(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n),
        root(text.count("!!") / n),
        root(sum(k for w, k in seen.items() if w.endswith(marks)) / n),
        root(sum(k for w, k in seen.items() if len(w) <= 3) / n),
        root(1 - len(set(lines)) / max(1, len(lines))),
        np.log1p(n / max(1, len(lines))),
        root(wide / letters),
        root(sum(k for w, k in seen.items() if len(w) > 3 and w.isupper()) / n),
    ]


def _statistics_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "tie", *(f"f{i}" for i in range(len(STATISTICS)))]
    for batch in batches:
        x = np.array([statistics(t.as_py()) for t in batch["text"]], float).reshape(len(batch), len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1]))], names)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, tie, f0, f1, ...``: ``tie`` is the text's hash."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).withColumn("tie", F.xxhash64("text")).mapInArrow(released(_statistics_tasks), FEATURES)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def fit(labelled: DataFrame) -> dict:
    """Two classes' parameters from ``label, f0, f1, ...``."""
    d = len(STATISTICS)
    cols = [F.col(f"f{i}") for i in range(d)]
    labelled = labelled.filter("label in (0, 1)")
    rows = {r["label"]: r for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).collect()}
    if len(rows) < 2 or min(r["n"] for r in rows.values()) < 2:
        n = sum(r["n"] for r in rows.values())
        return {"constant": rows[1]["n"] / n if 1 in rows else 0.0 if n else 0.5}
    left = [F.when(F.col("label") == 1, c - rows[1][f"m{i}"]).otherwise(c - rows[0][f"m{i}"]) for i, c in enumerate(cols)]
    centred = labelled.select("label", *[c.alias(f"c{i}") for i, c in enumerate(left)])
    products = {r["label"]: r for r in centred.groupBy("label").agg(*[F.avg(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]).collect()}
    means, covs, sizes = [], [], []
    for k in (0, 1):
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = products[k][f"p{i}_{j}"]
        means.append(np.array([rows[k][f"m{i}"] for i in range(d)])), covs.append(cov), sizes.append(rows[k]["n"])
    pooled = (covs[0] * sizes[0] + covs[1] * sizes[1]) / sum(sizes)
    classes = []
    for mean, cov, n in zip(means, covs, sizes, strict=True):
        shrunk = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
        shrunk = (1 - SHRINK_DIAGONAL) * shrunk + SHRINK_DIAGONAL * np.diag(np.diag(shrunk)) + RIDGE * np.eye(d)
        root = np.linalg.cholesky(shrunk)
        # the inverse factor is kept, so that a score is one product and no solve
        classes.append({"mean": mean, "whiten": np.linalg.inv(root).T, "offset": float(-np.log(np.diag(root)).sum() + np.log(n / sum(sizes)))})
    return {"classes": classes}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density (with prior) of class 1 less that of class 0."""
    bad, good = (c["offset"] - 0.5 * np.square((x - c["mean"]) @ c["whiten"]).sum(1) for c in model["classes"])
    return good - bad


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return 1 / (1 + np.exp(-np.clip(log_odds(model, x) / TEMPERATURE, -500, 500)))


def _score_tasks(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores(model, np.column_stack([batch[c].to_numpy() for c in COLUMNS]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], pa.array(score)], ["doc_id", "tie", "score"])

    return run


def trained(features: DataFrame, labels: DataFrame, folds: int, held_out_fold: int) -> dict:
    """The classes' parameters from the labelled rows of ``features (doc_id, f0, f1, ...)`` outside the held-out fold."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    return fit(stage(features.join(known.filter(fold_of(F.col("doc_id"), folds) != held_out_fold), "doc_id").select("label", *COLUMNS), "quality-training"))


def score_rows(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held_out_fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """``doc_id, tie, held_out, score, predicted`` of every document; ``tie`` tells rows of one id with different texts apart."""
    features = stage(document_statistics(docs), "quality-statistics")
    scored = features.mapInArrow(released(_score_tasks(trained(features, labels, folds, held_out_fold))), "doc_id long, tie long, score double")
    return scored.select("doc_id", "tie", (fold_of(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _row_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["row"].field("text")
        x = np.array([statistics(t.as_py() or "") for t in texts], float).reshape(len(batch), len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1]))], ["row", "doc_id", *COLUMNS])


def good_rows(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held_out_fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those predicted 0; rows without an id stay.

    A row is written with its statistics and keeps them beside it, so no text is exchanged to meet its score.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"))
    rows = rows.mapInArrow(released(_row_tasks), StructType([*rows.schema.fields, *(StructField(c, DoubleType()) for c in COLUMNS)]))
    rows = stage(rows, "quality-rows")
    model = trained(rows.select("doc_id", *COLUMNS), labels, folds, held_out_fold)

    @F.pandas_udf("double")
    def score(*columns):
        import pandas as pd

        return pd.Series(scores(model, np.column_stack(columns)))

    return rows.filter(F.col("doc_id").isNull() | (score(*COLUMNS) >= threshold)).select("row.*")


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return score_rows(docs, labels, **options).drop("tie")
