"""Content model: text and attribute vectors, neighbours, taste."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, OneHotEncoder, RegexTokenizer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyrec.functions.columns import minmax_all, minmax_within, top_k
from tallyrec.session import checkpointed, scratch, written


def product_text(products: DataFrame) -> DataFrame:
    """Name, leaf category twice, path words, band, attributes and description, lower-cased; absent columns are left out."""
    col = lambda c: F.col(c).cast("string") if c in products.columns else F.lit(None).cast("string")
    leaf = F.replace(col("category_id"), F.lit("-"), F.lit(" "))
    path = F.replace(F.replace(col("category_path"), F.lit("/"), F.lit(" ")), F.lit("-"), F.lit(" "))
    attributes = F.concat_ws(" ", F.transform(F.map_entries(F.from_json(col("attributes"), "map<string,string>")), lambda e: F.concat_ws(" ", e["key"], e["value"])))
    return products.select(F.col("id").alias("product_id"), F.lower(F.concat_ws(" ", col("name"), leaf, leaf, path, col("price_band"), attributes, col("description"))).alias("text"))


def dealt_text(products: DataFrame) -> DataFrame:
    """:func:`product_text`, dealt over as many tasks as the session has exchanges of: a catalogue is a small file of much text, which one task would read and work on alone."""
    tasks = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(product_text(products).repartition(tasks, "product_id"))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best finite scores of each row, ties to the smaller id (``ids`` ascend)."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, column = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], column[kept]


def tfidf(texts: DataFrame, max_features: int = 30_000, min_df: int = 2):
    """Fitted TF-IDF pipeline over words and word pairs, sublinear counts, unit rows in ``vector``."""
    words = [
        RegexTokenizer(inputCol="text", outputCol="raw", pattern=r"\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="raw", outputCol="words"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
    ]
    prepared = Pipeline(stages=words).fit(texts)
    joined = lambda df: prepared.transform(df).withColumn("terms", F.concat("words", "pairs"))
    counts = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=max_features, minDF=min_df).fit(joined(texts))

    def damped(df: DataFrame) -> DataFrame:
        return _sublinear(counts.transform(joined(df)))

    fitted = damped(texts)
    model = IDF(inputCol="tf", outputCol="weighted").fit(fitted)
    unit = Normalizer(inputCol="weighted", outputCol="vector")
    return lambda df: unit.transform(model.transform(fitted if df is texts else damped(df))).select("product_id", "vector")


def _sublinear(rows: DataFrame) -> DataFrame:
    """``product_id, tf``: ``counts`` damped, written as the struct that a vector is stored as and read as vectors, so that no row passes through Python."""
    c = F.unwrap_udt("counts")
    stored = F.struct(c["type"].alias("type"), c["size"].alias("size"), c["indices"].alias("indices"), F.transform(c["values"], lambda x: 1 + F.log(x)).alias("values"))
    path = scratch(rows.sparkSession, "term-counts")
    rows.select("product_id", stored.alias("tf")).write.parquet(path)
    schema = StructType([StructField("product_id", rows.schema["product_id"].dataType), StructField("tf", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)


#: Columns that a pass over the rows takes, how exact the factor has to be, and how little a pass may add before it is the last.
PASS, EXACT, ADDED = 32, 1e-9, 1e-7


def _partial_products(batches, q: np.ndarray):
    """One task's part of ``A' A q``, as bytes; ``batches`` have the rows of ``A`` as ``i`` and ``v``."""
    import pyarrow as pa

    total = np.zeros(q.shape)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            some = batch.slice(at, 2000)
            i, v = some.column("i").flatten().to_numpy(), some.column("v").flatten().to_numpy()
            if not len(i):
                continue
            row = np.repeat(np.arange(some.num_rows), np.diff(some.column("i").offsets.to_numpy()))
            y = np.zeros((some.num_rows, q.shape[1]))
            full, first = np.unique(row, return_index=True)
            y[full] = np.add.reduceat(q[i] * v[:, None], first)
            by_term = np.argsort(i, kind="stable")
            terms, start = np.unique(i[by_term], return_index=True)
            total[terms] += np.add.reduceat(y[row[by_term]] * v[by_term, None], start)
    yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})


def _right_factor(rows: DataFrame, n: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` largest squared singular values of ``rows (i, v)`` and their right vectors (terms by rank).

    Block Lanczos with full orthogonalisation: a pass over the rows multiplies ``PASS`` vectors at once, and no vector is thrown
    away, so values that lie close together don't ask for hundreds of passes as restarts do.  It ends when every residual is
    below ``EXACT`` of the largest value, or two passes together added less than ``ADDED`` of what is kept.
    """
    context = rows.sparkSession.sparkContext
    rng = np.random.default_rng(42)
    q = np.linalg.qr(rng.normal(size=(n, min(n, PASS))))[0]
    basis, upper, kept = q, np.zeros((0, 0)), []
    while True:
        sent = context.broadcast(q)
        parts = rows.mapInArrow(lambda batches, sent=sent: _partial_products(batches, sent.value), "part binary").rdd
        z = parts.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add).reshape(q.shape)
        sent.unpersist()
        inside = basis.T @ z
        rest = z - basis @ inside
        again = basis.T @ rest
        rest, inside = rest - basis @ again, inside + again
        old = len(upper)
        upper = np.pad(upper, ((0, len(inside) - old), (0, len(inside) - old)))
        upper[:, old:] = inside
        upper[old:, :old] = inside[:old].T
        values, vectors = np.linalg.eigh((upper + upper.T) / 2)
        values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
        q, left = np.linalg.qr(rest)
        kept.append(values.sum())
        exact = len(values) == rank and np.linalg.norm(left @ vectors[old:], axis=0).max() <= EXACT * max(values[0], 1e-300)
        settled = len(values) == rank and len(kept) > 2 and kept[-1] - kept[-3] <= ADDED * kept[-1]
        if exact or settled or basis.shape[1] == n:
            break
        q = q[:, : n - basis.shape[1]]
        for _ in range(2):  # a rest of lower rank leaves columns that need it
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        basis = np.hstack([basis, q])
    right = basis @ vectors
    return np.maximum(values, 0.0), right * np.where(right[np.abs(right).argmax(0), np.arange(right.shape[1])] < 0, -1.0, 1.0)


def reduce_rank(vectors: DataFrame, rank: int) -> tuple[DataFrame, float]:
    """``product_id, vector`` in ``rank`` dimensions by truncated SVD, and the share of variance kept.

    The right factor and the vectors it is made of (terms by rank, and some passes) are the only things that reach the driver; their size is set
    by the vocabulary.  The rows are written once and read in each pass.
    """

    p = F.unwrap_udt("vector")
    opened = written(vectors.select("product_id", p["size"].alias("n"), p["indices"].alias("i"), p["values"].alias("v")), "rows-to-reduce")
    n, total = opened.agg(F.max("n"), F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n or not total:
        return opened.select("product_id", F.array_repeat(F.lit(0.0), min(rank, n or 0)).alias("vector")), 0.0
    values, right = _right_factor(opened.select("i", "v"), n, min(rank, n - 1) or 1)
    shared = vectors.sparkSession.sparkContext.broadcast(right)

    @F.pandas_udf("array<double>")
    def project(indices, values):
        import pandas as pd

        return pd.Series([np.asarray(v) @ shared.value[np.asarray(i, int)] if len(i) else np.zeros(shared.value.shape[1]) for i, v in zip(indices, values, strict=True)])

    return opened.select("product_id", project("i", "v").alias("vector")), float(values.sum()) / total


def attribute_vectors(products: DataFrame) -> DataFrame:
    """One-hot category, brand and band, and scaled log price."""
    tasks = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = products.select(F.col("id").alias("product_id"), "category_id", "brand_id", "price_band", F.log1p("price").alias("log_price")).repartition(tasks, "product_id")
    rows = minmax_all(rows, "log_price")
    names = ["category_id", "brand_id", "price_band"]
    index = StringIndexer(inputCols=names, outputCols=[f"{c}_i" for c in names], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in names], outputCols=[f"{c}_v" for c in names], dropLast=False)
    gathered = VectorAssembler(inputCols=[*(f"{c}_v" for c in names), "log_price"], outputCol="attributes")
    return Pipeline(stages=[index, hot, gathered]).fit(rows).transform(rows).select("product_id", vector_to_array("attributes").alias("attributes"))


def unit(values):
    size = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    # bound to a variable, as it would be summed anew for each value otherwise
    return F.transform(F.array(size), lambda s: F.when(s > 0, F.transform(values, lambda x: x / s)).otherwise(values))[0]


def combine(text: DataFrame, attributes: DataFrame, *, text_share: float = 0.6, attribute_share: float = 0.4) -> DataFrame:
    """Unit vectors of both parts, weighted and joined, made unit again."""
    met = text.join(attributes, "product_id")
    joined = F.concat(F.transform(unit(F.col("vector")), lambda x: x * text_share), F.transform(unit(F.col("attributes")), lambda x: x * attribute_share))
    return met.select("product_id", joined.alias("both")).select("product_id", unit(F.col("both")).alias("vector"))


#: Rows of one product of blocks that are scored at once.
STRIP = 500


def once_each(rows: DataFrame, k: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ``k`` nearest of each of ``rows (id, v)``, itself excluded: ``item, neighbour, score, rank``.

    ``search`` takes rows of different vectors and gives the ``k`` nearest of each (``query, id, score``).  Items of one vector are
    searched as one, the smallest id; each of them then takes the best of what the group has found and of the group itself.
    """
    keyed = checkpointed(rows.withColumns({"h": F.xxhash64(F.lit(1), "v"), "g": F.xxhash64(F.lit(2), "v")}))
    ranked = top_k(keyed.withColumn("s", F.lit(0)), ["h", "g"], "s", "id", k + 1)
    groups = checkpointed(ranked.groupBy("h", "g").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")))
    found = search(groups.select("id", "v"))
    of_others = found.select("query", "id", "score").join(groups.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("neighbour"))
    itself = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    of_own = groups.select(F.col("id").alias("query"), itself.alias("score"), F.explode("ids").alias("neighbour"))
    best = top_k(of_others.unionByName(of_own), ["query"], "score", "neighbour", k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "score"))).alias("near"))
    by_group = groups.select("h", "g", F.col("id").alias("query")).join(lists, "query").select("h", "g", "near")
    own = keyed.select("id", "h", "g").join(by_group, ["h", "g"])
    opened = own.select(F.col("id").alias("item"), F.posexplode(F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("at", "x"))
    return opened.select("item", F.col("x.neighbour").alias("neighbour"), F.col("x.score").alias("score"), (F.col("at") + 1).alias("rank"))


def similar(vectors: DataFrame, k: int, block: int = 8000, item: str = "product_id") -> DataFrame:
    """Exact ``k`` nearest by cosine, itself excluded: ``item, neighbour, score, rank``.

    Equal vectors are searched for once (:func:`once_each`).  Vectors are dealt into blocks of about ``block`` rows; each pair of blocks is one
    task's matrix product, which serves both of them and of which only the ``k`` best a row are kept.  It is
    formed ``STRIP`` rows at a time.
    """
    rows = vectors.select(F.col(item).cast("long").alias("id"), unit(F.col("vector").cast("array<double>")).alias("v")).filter("id is not null and v is not null")
    return once_each(rows, k, lambda firsts: _nearest_blocks(firsts, k, block))


def _nearest_blocks(rows: DataFrame, k: int, block: int) -> DataFrame:
    """``query, id, score``: the ``k`` nearest of each of ``rows (id, v)``, every pair of blocks compared."""
    n = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = dealt.select(F.least("own", "other").alias("b"), F.greatest("own", "other").alias("c"), "own", "id", "v")

    def best(key, frame):
        import pandas as pd

        sides = [f.sort_values("id") for f in (frame[frame["own"] == key[0]], frame[frame["own"] == key[1]])]
        out = []
        for a, b in [sides, sides[::-1]] if key[0] != key[1] else [sides]:
            if not len(a) or not len(b):
                continue
            x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
            ids, others = a["id"].to_numpy(), b["id"].to_numpy()
            for at in range(0, len(ids), STRIP):
                some = ids[at : at + STRIP]
                scores = x[at : at + STRIP] @ y.T
                scores[some[:, None] == others[None, :]] = -np.inf
                row, column = best_of(scores, others, k)
                out.append(pd.DataFrame({"query": some[row], "id": others[column], "score": scores[row, column]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "score": []})

    found = met.groupBy("b", "c").applyInPandas(best, "query long, id long, score double")
    return top_k(found, ["query"], "score", "id", k)


def taste(anchors: DataFrame, vectors: DataFrame, keep: int = 40) -> DataFrame:
    """Unit mean of the vectors of each user's first ``keep`` anchors (``rank`` from 1)."""
    met = anchors.filter(F.col("rank") <= keep).join(vectors.filter(F.size("vector") > 0), "product_id")
    means = met.groupBy("user_id").agg(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>"))).alias("m"))
    return means.select("user_id", vector_to_array("m").alias("v")).select("user_id", unit(F.col("v")).alias("vector"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score(candidates: DataFrame, tastes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of each candidate (user, product)."""
    met = candidates.join(tastes.withColumnRenamed("vector", "u"), "user_id", "left").join(vectors.withColumnRenamed("vector", "v"), "product_id", "left")
    return met.withColumn("content_similarity", F.coalesce(dot(F.col("u"), F.col("v")), F.lit(0.0))).drop("u", "v")


def _searched(tastes: DataFrame, vectors: DataFrame, seen: DataFrame, k: int, block: int) -> DataFrame:
    """Each user's ``k`` products of largest product that aren't seen (``user_id, product_id, score, rank``); exact.

    Products of one vector are searched as one group.  A group that a user has seen some of is scored, but chosen apart: how many of it are
    left is known, and groups stay in until those of better score have ``k`` products left.  These are opened then, and what is seen is left out.
    """
    keyed = checkpointed(vectors.select("product_id", "vector", F.xxhash64(F.lit(1), "vector").alias("h"), F.xxhash64(F.lit(2), "vector").alias("g")))
    met = seen.select("user_id", "product_id").distinct()
    touched = checkpointed(met.join(keyed.select("product_id", "h", "g"), "product_id").groupBy("user_id", "h", "g").agg(F.count(F.lit(1)).alias("gone")))
    most = k + (touched.agg(F.max("gone")).first()[0] or 0)
    members = checkpointed(top_k(keyed.withColumn("s", F.lit(0)), ["h", "g"], "s", "product_id", most, rank="at").select("h", "g", "product_id", "at", F.when(F.col("at") == 1, F.col("vector")).alias("vector")))
    groups = checkpointed(members.groupBy("h", "g").agg(F.min("product_id").alias("first"), F.max_by("vector", F.col("vector").isNotNull()).alias("vector"), F.count(F.lit(1)).alias("size")))
    gone = touched.join(groups.select("h", "g", "first"), ["h", "g"]).select("user_id", "first", "gone")
    found = _met_blocks(tastes, groups.select(F.col("first").alias("product_id"), "vector"), gone.select("user_id", F.col("first").alias("product_id")), k, block)
    apart = found.filter("touched").select("user_id", F.col("product_id").alias("first"), "score").join(gone, ["user_id", "first"])
    whole = top_k(found.filter("not touched"), ["user_id"], "score", "product_id", k).select("user_id", F.col("product_id").alias("first"), "score", F.lit(0).cast("long").alias("gone"))
    left = apart.unionByName(whole).join(groups.select("first", "size"), "first").withColumn("left", F.col("size") - F.col("gone")).filter("left > 0")
    better = F.sum("left").over(W.partitionBy("user_id").orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("left").over(W.partitionBy("user_id", "score"))
    kept = left.withColumn("better", better).filter(F.col("better") < k)
    of_group = members.join(groups.select("h", "g", "first"), ["h", "g"]).select("first", "product_id", "at")
    opened = kept.join(of_group, "first").filter(F.col("at") <= F.col("gone") + k).select("user_id", "product_id", "score")
    return top_k(opened.join(met, ["user_id", "product_id"], "left_anti"), ["user_id"], "score", "product_id", k)


def _met_blocks(tastes: DataFrame, vectors: DataFrame, seen: DataFrame, k: int, block: int) -> DataFrame:
    """``user_id, product_id, score, touched``, block by block: the ``k`` best that aren't in ``seen``, and those that are."""
    n_u, n_v = max(1, -(-tastes.count() // block)), max(1, -(-vectors.count() // block))
    of_user, of_product = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("user_id", n_u), ("product_id", n_v)))
    none = F.lit(None)
    u = tastes.select(F.col("user_id").alias("id"), none.cast("long").alias("other"), F.col("vector").alias("v"), of_user.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("c"), F.lit(0).alias("side"))
    v = vectors.select(F.col("product_id").alias("id"), none.cast("long").alias("other"), F.col("vector").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n_u - 1))).alias("b"), of_product.alias("c"), F.lit(1).alias("side"))
    s = seen.select("user_id", "product_id").distinct().select(F.col("user_id").alias("id"), F.col("product_id").alias("other"), none.cast("array<double>").alias("v"), of_user.alias("b"), of_product.alias("c"), F.lit(2).alias("side"))

    def best(frame):
        import pandas as pd

        a, b, met = (frame[frame["side"] == side].sort_values("id") for side in (0, 1, 2))
        if not len(a) or not len(b):
            return pd.DataFrame({"user_id": [], "product_id": [], "score": [], "touched": []})
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        users, products = a["id"].to_numpy(), b["id"].to_numpy()
        row, column = pd.Index(users).get_indexer(met["id"]), pd.Index(products).get_indexer(met["other"])
        out = []
        for at in range(0, len(users), STRIP):
            scores = x[at : at + STRIP] @ y.T
            there = (row >= at) & (row < at + STRIP) & (column >= 0)
            out.append(pd.DataFrame({"user_id": users[row[there]], "product_id": products[column[there]], "score": scores[row[there] - at, column[there]], "touched": True}))
            scores[row[there] - at, column[there]] = -np.inf
            i, j = best_of(scores, products, k)
            out.append(pd.DataFrame({"user_id": users[at + i], "product_id": products[j], "score": scores[i, j], "touched": False}))
        return pd.concat(out)

    # written, as the best and the seen ones are read apart
    return written(u.unionByName(v).unionByName(s).groupBy("b", "c").applyInPandas(best, "user_id long, product_id long, score double, touched boolean"), "met-blocks")


def recommend(tastes: DataFrame, vectors: DataFrame, seen: DataFrame, k: int, block: int = 8000) -> DataFrame:
    """Each user's ``k`` nearest products that aren't seen, scores 0 to 1; exact, block by block."""
    return _searched(tastes, vectors, seen, k, block).withColumn("score", minmax_within(F.col("score"), ["user_id"]))


def similar_to(asked: DataFrame, vectors: DataFrame, k: int, block: int = 8000, item: str = "product_id") -> DataFrame:
    """Exact ``k`` nearest by cosine of the items in ``asked`` among all of ``vectors``, itself excluded: ``item, neighbour, score, rank``."""
    rows = written(vectors.select(F.col(item).alias("product_id"), unit(F.col("vector").cast("array<double>")).alias("vector")), "unit-vectors")
    queries = rows.join(asked.select(F.col(item).alias("product_id")).distinct(), "product_id", "left_semi").withColumnRenamed("product_id", "user_id")
    own = queries.select("user_id", F.col("user_id").alias("product_id"))
    return _searched(queries, rows, own, k, block).select(F.col("user_id").alias("item"), F.col("product_id").alias("neighbour"), "score", "rank")


def changed(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts whose hash isn't stored yet (``product_id, source_hash``): those to embed again."""
    return texts.withColumn("source_hash", F.sha2("text", 256)).join(stored.select("product_id", "source_hash"), ["product_id", "source_hash"], "left_anti")


def ranks_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "product_id")))


def as_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("product_id"), F.col("embedding").cast("array<double>").alias("vector"))


def to_ml(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vector", array_to_vector("vector"))
