"""The inverted-file index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrec.operators import candidates, content, neighbours
from tallyrec.plans import queries_lists, registry

SF = "/root/testdata/sf0.01"
VECTORS = "product_id long, vector array<double>"


def recall(found, exact, query, item):
    a = {(r[query], r[item]) for r in found.collect()}
    b = [(r[query], r[item]) for r in exact.collect()]
    return sum(x in a for x in b) / len(b)


def clustered(spark, n=3000, groups=40, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    v = centres[rng.integers(0, groups, n)] + 0.2 * rng.normal(size=(n, width))
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], VECTORS)


def test_recall_on_the_embeddings(spark):
    exact = content.similar(content.as_vectors(spark.read.parquet(f"{SF}/embeddings.parquet")), 5)
    found = registry.load()["g13_indexed_embeddings"](spark, SF)
    assert found.count() == exact.count() and recall(found, exact, "item", "neighbour") >= 0.9


def test_few_lists_are_read_where_vectors_are_clustered(spark):
    vectors = clustered(spark)
    rows = neighbours._rows(vectors, "product_id").withColumn("v", content.unit(F.col("v")))
    index = neighbours.build(rows, k=10)
    assert len(index.centres) == 55 and index.probes <= 12 and index.recall >= 0.95
    found = neighbours.similar(vectors, 10, block=50)
    assert recall(found, content.similar(vectors, 10), "item", "neighbour") >= 0.9


def test_all_lists_read_is_exact_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(200)] + [(200, None), (None, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, VECTORS)
    got = neighbours.similar(vectors, 6, target=1.0, lists=5, block=7).collect()
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if v and i is not None}
    for i in unit:
        mine = [(r.neighbour, r.score) for r in sorted((r for r in got if r.item == i), key=lambda r: r["rank"])]
        want = sorted(((j, float(unit[i] @ unit[j])) for j in unit if j != i), key=lambda x: (-round(x[1], 9), x[0]))[:6]
        assert [j for j, _ in mine] == [j for j, _ in want]
        assert [s for _, s in mine] == pytest.approx([s for _, s in want], abs=1e-9)


def test_many_equal_vectors_are_one(spark):
    """A third of the items share one vector: they are searched for once, and still find each other."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(500)] + [(500 + i, [float(x) for x in rng.normal(size=4)]) for i in range(1000)]
    got = neighbours.similar(spark.createDataFrame(rows, VECTORS), 4)
    copies = got.filter("item < 500").groupBy("item").agg(F.collect_list("neighbour").alias("n")).collect()
    assert len(copies) == 500
    for r in copies:
        assert sorted(r.n) == [x for x in range(5) if x != r.item][:4]


def test_recommendations_by_product(spark):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8) * rng.uniform(0.2, 3)]) for i in range(900)], VECTORS)
    users = spark.createDataFrame([(u, [float(x) for x in rng.normal(size=8)]) for u in range(120)], "user_id long, vector array<double>")
    seen = spark.createDataFrame([(int(rng.integers(120)), int(rng.integers(900))) for _ in range(4000)], "user_id long, product_id long")
    exact = content.recommend(users, items, seen, 10)
    got = neighbours.recommend(users, items, seen, 10, block=40)
    assert recall(got, exact, "user_id", "product_id") >= 0.9
    assert got.join(seen, ["user_id", "product_id"]).count() == 0
    whole = neighbours.recommend(users, items, seen, 10, target=1.0, lists=6)
    a, b = ({(r.user_id, r["rank"]): r for r in df.collect()} for df in (whole, exact))
    same = sum(a[x].product_id == b[x].product_id for x in b)
    assert same >= 0.99 * len(b)
    assert all(abs(a[x].score - b[x].score) < 1e-6 for x in b)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], VECTORS)
    assert neighbours.similar(none, 3).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], VECTORS)
    assert neighbours.similar(one, 3).count() == 0


def test_no_list_is_whole_in_a_task(spark):
    """Blocks of lists meet blocks of queries; nothing is joined without a list in common."""
    rows = neighbours._rows(clustered(spark, 600), "product_id").withColumn("v", content.unit(F.col("v")))
    index = neighbours.build(rows, k=5, lists=3)
    plan = neighbours.search(index, rows, 5, own=True, block=50)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_the_indexed_search_asks_every_fiftieth_user(spark):
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    found = registry.load()["g15_indexed_for_users"](spark, t.dir)
    v = queries_lists.content_vectors(t)
    exact = content.recommend(content.taste(candidates.contexts(t.rows).filter("user_id % 50 = 0"), v), v, t.rows.select("user_id", "product_id"), 10)
    assert {r.user_id % 50 for r in found.collect()} == {0}
    assert recall(found, exact, "user_id", "product_id") >= 0.9
