"""The two-stage run: ten retrieval sources, a fused pool, rankers, blending and diversity, evaluated side by side.

Everything is learned from the train fold; rankers learn from what users did in the validation fold with the
candidates and features of the train fold, and all variants are measured on the test fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrec.functions.columns import top_k
from tallyrec.operators import candidates as cand
from tallyrec.operators import collaborative, content, cooccurrence, evaluation, features, listwise, neighbours, popularity, ranking, rerank, weighting
from tallyrec.session import checkpointed
from tallyrec.sources.io import Dataset

#: A model's list as a component of the blend.
BLENDED = {"collaborative": "collaborative", "content": "content", "trending": "trending", "affinity": "category_affinity", "popularity": "popularity"}


class Retrieval:
    """Models of a train fold ``past`` and the candidates they give ``users``."""

    def __init__(self, past: DataFrame, data: Dataset, as_of, users: DataFrame, *, als: dict | None = None, rank: int = 384, size: int = 300):
        self.past, self.data, self.as_of, self.users = past, data, as_of, users
        products = data.products
        worth = {kind: found["weight"] for kind, found in weighting.calibrate(past).items()}
        self.weights = checkpointed(weighting.interaction_matrix(past, worth, as_of))
        self.bought = checkpointed(past.filter("event_type = 'PURCHASE'").select("user_id", "product_id").distinct())
        self.seen = checkpointed(past.select("user_id", "product_id").distinct())
        self.recent = checkpointed(cand.contexts(past))
        self.popular = checkpointed(popularity.popular_scores(self.weights))
        self.trending = checkpointed(popularity.trending(past, as_of))
        self.by_category = checkpointed(popularity.popular_by_category(self.weights, products))
        self.categories = checkpointed(features.affinity(past, self.weights, products, "category_id", 10))
        self.brands = checkpointed(features.affinity(past, self.weights, products, "brand_id", 6))
        self.covisited = checkpointed(cooccurrence.covisited(past))
        self.together = checkpointed(cooccurrence.bought_together(data.order_items.join(data.orders.filter(F.col("placed_at") < as_of).select(F.col("id").alias("order_id")), "order_id")))
        self.factors = collaborative.fit(collaborative.supported(self.weights), **(als or {}))
        texts = content.dealt_text(products)
        reduced, _ = content.reduce_rank(content.tfidf(texts)(texts), rank)
        self.vectors = checkpointed(content.combine(reduced, content.attribute_vectors(products)))
        self.tastes = checkpointed(content.taste(self.recent.join(users, "user_id", "left_semi"), self.vectors))
        self.user_features = checkpointed(features.user_features(past, products, as_of, data.orders))
        self.product_features = checkpointed(features.product_features(past, products, as_of))
        self.gathered = checkpointed(cand.gather(self.sources()))
        fused = cand.allowed(cand.fuse(self.gathered), products, self.bought)
        self.pool = checkpointed(cand.pool(fused, size))

    def sources(self) -> dict[str, DataFrame]:
        """All ten, each within its budget and without what was bought."""
        users, ex, recent, products = self.users, self.bought, self.recent.join(self.users, "user_id", "left_semi"), self.data.products
        category = popularity.top_by_group(self.popular, products, "category_id", 60)
        brand = popularity.top_by_group(self.popular, products, "brand_id", 40)
        of = lambda affinities: affinities.join(users, "user_id", "left_semi")
        cold = self.product_features.filter("is_cold = 1")
        known = self.factors.users.join(users, "user_id", "left_semi")
        nearest = lambda who, items, n: neighbours.recommend(who, items, ex, n).withColumn("rank", F.col("rank") - 1).select(*cand.COLUMNS)
        return {
            "collaborative": nearest(known, self.factors.items, 150),
            "content": nearest(self.tastes, self.vectors, 100),
            "covisitation": cand.neighbour_source(recent, self.covisited, ex, 80),
            "frequently_bought": cand.neighbour_source(recent, self.together, ex, 40),
            "category_affinity": cand.affinity_source(of(self.categories), category, "category_id", ex, 60, 6),
            "brand_affinity": cand.affinity_source(of(self.brands), brand, "brand_id", ex, 40, 5),
            "trending": cand.static_source(self.trending.filter("rank <= 300"), users, ex, 40),
            "popularity": cand.static_source(popularity.top_items(self.popular, 500), users, ex, 40),
            "recently_viewed": cand.recent_source(recent, ex, 20),
            "exploration": cand.exploration_source(cold, users, ex, 15),
        }

    def rows(self) -> DataFrame:
        """The ranker's columns for every candidate."""
        pairs = collaborative.score(content.score(self.pool.select("user_id", "product_id"), self.tastes, self.vectors), self.factors)
        history = features.pair_history(self.past, self.as_of)
        both = features.pair_features(pairs, history, self.weights, self.categories, self.brands, self.product_features, self.user_features)
        return checkpointed(ranking.assemble(self.user_features, self.product_features, both, ranking.source_features(self.gathered, self.pool)))

    def list_of(self, source: str, k: int) -> DataFrame:
        """A single source's list, among what may be shown."""
        own = self.gathered.filter(F.col("source") == source).join(self.pool.select("user_id", "product_id"), ["user_id", "product_id"], "left_semi")
        return top_k(own.select("user_id", "product_id", "score"), ["user_id"], "score", "product_id", k)

    def hybrid(self) -> DataFrame:
        """The pool's candidates by all five components, weighted by how much history a user has."""
        own = lambda source: self.gathered.filter(F.col("source") == source).join(self.pool.select("user_id", "product_id"), ["user_id", "product_id"], "left_semi")
        counts = self.past.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        scored = rerank.blend(rerank.component_scores({name: own(source) for name, source in BLENDED.items()}), counts)
        return rerank.boost_novelty(scored.select("user_id", "product_id", "score"), self.product_features)

    def diverse(self, scored: DataFrame, k: int) -> DataFrame:
        keyed = scored.join(self.data.products.select(F.col("id").alias("product_id"), "category_id", "brand_id"), "product_id")
        return rerank.diversify(keyed, k)


def variants(found: Retrieval, wanted: DataFrame, k: int = 20, *, boosting: dict | None = None) -> dict[str, DataFrame]:
    """The lists of all variants; rankers learn from ``wanted (user_id, product_id, label)``."""
    rows = found.rows()
    labelled = checkpointed(ranking.sample_negatives(ranking.keep_answered(ranking.with_labels(rows, wanted))))
    hybrid = checkpointed(found.hybrid())
    best = lambda df: top_k(df.select("user_id", "product_id", "score"), ["user_id"], "score", "product_id", k)
    out = {name: found.list_of(source, k) for name, source in {"popularity-global": "popularity", "popularity-category": "category_affinity", "trending": "trending", "covisitation": "covisitation", "content": "content", "collaborative-als": "collaborative"}.items()}
    out |= {"hybrid": best(hybrid), "hybrid + diversity": found.diverse(hybrid, k)}
    if labelled.limit(1).count():
        models: dict[str, Callable[[], DataFrame]] = {
            "two-stage-logistic": lambda: ranking.score_pool(ranking.pointwise(labelled), rows, 3 * k),
            "two-stage-ranker": lambda: listwise.score_pool(listwise.fit(labelled, **(boosting or {})), rows, 3 * k),
        }
        for name, scored in models.items():
            own = checkpointed(scored())
            out |= {name: best(own), f"{name} + diversity": found.diverse(own, k)}
    return out


def run(data: Dataset, folds: DataFrame, *, k: int = 20, primary_k: int = 10, als: dict | None = None, boosting: dict | None = None, rank: int = 384, size: int = 300) -> DataFrame:
    """``model`` with its accuracy on the test fold, coverage, diversity and novelty; ``folds`` as split_temporal gives them."""
    folds = checkpointed(folds)
    past = folds.filter("fold = 'train'").drop("fold")
    cut = folds.filter("fold <> 'train'").agg(F.unix_micros(F.min("occurred_at"))).first()[0]
    users = checkpointed(folds.filter("fold <> 'train'").select("user_id").distinct())
    found = Retrieval(past, data, F.timestamp_micros(F.lit(cut).cast("long")), users, als=als, rank=rank, size=size)
    wanted = ranking.labels(folds.filter("fold = 'validation'"))
    recs = None
    for name, df in variants(found, wanted, k, boosting=boosting).items():
        one = df.select(F.lit(name).alias("model"), "user_id", "product_id", F.col("rank").cast("int").alias("rank"))
        recs = one if recs is None else recs.unionByName(one)
    tested = folds.filter("fold = 'test'").select("user_id").distinct()
    recs = checkpointed(recs.join(tested, "user_id", "left_semi"))
    targets = evaluation.graded_targets(folds, "test")
    scored = evaluation.means(evaluation.accuracy(recs, targets, primary_k), evaluation.segments(past, targets))
    beyond = evaluation.coverage(recs, data.products.count()).join(evaluation.intra_list_diversity(recs, data.products), "model").join(evaluation.novelty(recs, past), "model")
    return evaluation.comparison(scored).join(beyond, "model")
