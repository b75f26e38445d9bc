import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyrec.llm import decontaminate, packing, passages, quality_model, queries, simhash

SF = "/root/testdata/sf0.001"
rng = random.Random(4)


def prose(n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


PASSAGE = prose(80)
TEXTS = [(i, f"{prose(60)} {PASSAGE} {prose(60)}" if i < 4 else prose(150)) for i in range(12)] + [(20, None), (21, ""), (None, PASSAGE), (22, prose(5) + "\n" + "w " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "s", len(t or "")) for d, t in TEXTS], "doc_id long, text string, n_words string, n_chars long")


def test_repeated_passage_stays_once(spark, docs):
    out = {r.doc_id: r for r in passages.remove_repeats(docs).collect()}
    inner = " ".join(PASSAGE.split()[15:65])
    assert [d for d, r in out.items() if d is not None and r.text and inner in r.text] == [0]
    before = dict(TEXTS)
    for d in list(range(4, 12)) + [20, 21, 22, None]:
        assert out[d].text == before[d]
    assert all(out[d].n_chars == len(out[d].text) < len(before[d]) for d in (1, 2, 3))
    assert passages.remove_repeats(docs.limit(0)).count() == 0


def test_runs_name_members_and_keeper(spark, docs):
    rows = passages.repeated_runs(docs).collect()
    assert {(r.doc_id, r.removed) for r in rows} == {(0, False), (1, True), (2, True), (3, True)}
    assert all(r.keeper_doc_id == 0 and r.n_words >= 20 for r in rows)


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(before + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_edit_distance():
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        assert passages.edit_distance(a, b) == slow_edits(a, b)


def alike(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) >= 0.8 * len(x | y) or slow_edits(a, b) <= 0.1 * max(len(a), len(b))


@pytest.mark.parametrize("crowd", [1000, 1])
def test_near_links_equal_brute_force(spark, crowd):
    found = {}
    for i in range(150):
        n = rng.randrange(20, 130)
        found[2 * i] = [rng.randrange(1 << 31) for _ in range(n)]
        copy = list(found[2 * i])
        # none, one in 30, one in 15 or one in 7 changed, dropped or put in
        for j in sorted(rng.sample(range(n), (0, n // 30, n // 15, n // 7)[i % 4]), reverse=True):
            copy[j : j + 1] = [[rng.randrange(1 << 31)], [], [copy[j], rng.randrange(1 << 31)]][i % 3]
        found[2 * i + 1] = copy
    rows = spark.createDataFrame(list(found.items()), "pid long, words array<int>")
    got = {tuple(sorted((r.a, r.b))) for r in passages.near_links(rows, crowd=crowd).collect()}
    want = {(2 * i, 2 * i + 1) for i in range(150) if alike(found[2 * i], found[2 * i + 1])}
    assert got <= want and len(got) >= 0.97 * len(want) and 100 < len(want) < 150


def test_a_crowd_of_near_copies_is_one_cluster(spark):
    core = [rng.randrange(1 << 31) for _ in range(60)]
    rows = [(k, [w if j != k % 60 else k for j, w in enumerate(core)]) for k in range(300)] + [(1000 + k, [rng.randrange(1 << 31) for _ in range(60)]) for k in range(50)]
    links = passages.near_links(spark.createDataFrame(rows, "pid long, words array<int>"), crowd=20)
    from tallyrec.llm.components import connected_components

    assert {(r.node, r.root) for r in connected_components(links).collect()} == {(k, 0) for k in range(1, 300)}


@pytest.mark.parametrize("size", [50, 60, 100])
def test_paragraphs_with_a_word_in_15_changed_are_removed(spark, size):
    rows = []
    for k in range(60):
        own = prose(size).split()
        copy = [w if j % 15 != 7 else "changed" for j, w in enumerate(own)]
        rows += [(2 * k, f"{prose(40)}\n{' '.join(own)}\n{prose(30)}"), (2 * k + 1, f"{prose(25)}\n{' '.join(copy)}\n{prose(45)}")]
    out = {r.doc_id: r.text.split() for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = [d for d, t in rows if out[d] == (t.split("\n")[0] + " " + t.split("\n")[2]).split()]
    assert {d % 2 for d in gone} == {1} and len(gone) >= 54 and all(out[d] == t.split() for d, t in rows if d not in gone)


@pytest.mark.parametrize("make", [lambda p, k: f"{prose(40)}\n{p}\n{prose(40)}", lambda p, k: f"{prose(9)}\n\n" + p.replace(". ", ".\n") + f"\n\n{prose(40)}", lambda p, k: p])
def test_ties_and_short_lines(spark, make):
    """The smallest document keeps a paragraph, whether it is a line, a row of short lines or the whole text, and keeps its first place of it."""
    passage = ". ".join(prose(9) for _ in range(6))
    rows = [(d, make(passage, d)) for d in (5, 3, 3, 9)] + [(3, "another row of the same id"), (None, make(passage, 0))]
    out = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    inner = passage.split()[10:40]
    has = [r.doc_id for r in out if " ".join(inner) in " ".join((r.text or "").split())]
    assert sorted(has, key=str) == [3, 3, None]


def test_a_very_long_text_is_cut(spark):
    passage = prose(60)
    rows = [(1, f"{prose(30_000)} {passage} {prose(3000)}"), (2, f"{prose(20)} {passage} {prose(20)}")]
    out = {r.doc_id: r.text for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and " ".join(passage.split()[15:45]) not in out[2]


def test_paragraphs_follow_the_words():
    words = np.array([passages._Hashes()[w.encode()] for w in PASSAGE.split()], np.uint64)
    moved = np.concatenate([words[30:50], words, words[:9]])
    inner = set(np.diff(passages.cuts(words))[1:-1].tolist())
    assert set((passages.cuts(moved) - 20)[(passages.cuts(moved) >= 26) & (passages.cuts(moved) < 94)].tolist()) == set(x for x in passages.cuts(words).tolist() if 6 <= x < 74) and inner


def check_packing(rows, lengths, sources, clusters, capacity):
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r[4], []).append(r)
        pieces.setdefault(r[0], []).append((r[2], r[3]))
    for found in bins.values():
        assert sum(r[3] for r in found) <= capacity
        for of in (sources, clusters):
            seen = [of[r[0]] for r in found if of[r[0]] is not None]
            assert len(seen) == len(set(seen))
        spans = sorted((r[5], r[3]) for r in found)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    for d, n in lengths.items():
        spans = sorted(pieces[d])
        assert spans[0][0] == 0 and sum(x[1] for x in spans) == n


def slow_best_fit(docs, capacity):
    """Plain best-fit decreasing: the tightest bin without conflict; of equals, among those that hold what the one waiting longest holds, the latest."""
    bins, placed = [], {}
    for step, (d, s, c, n) in enumerate(sorted(docs, key=lambda d: (-d[3], d[0]))):
        fit = [b for b in bins if b["left"] >= n and not (s is not None and s in b["s"]) and not (c is not None and c in b["c"])]
        if fit:
            fit = [b for b in fit if b["left"] == min(b["left"] for b in fit)]
            oldest = min(fit, key=lambda b: b["since"])
            best = max((b for b in fit if (b["s"], b["c"]) == (oldest["s"], oldest["c"])), key=lambda b: b["since"])
        else:
            best = {"left": capacity, "s": frozenset(), "c": frozenset(), "docs": []}
            bins.append(best)
        best["left"] -= n
        # only what several documents have can conflict
        best["s"] |= {s} - {None}
        best["c"] |= {c} - {None} if sum(x[2] == c for x in docs) > 1 else frozenset()
        best["since"] = step
        best["docs"].append(d)
    return sorted(b["docs"] for b in bins)


def packed_bins(docs, capacity):
    bins = {}
    for r in packing.pack_group(docs, capacity):
        bins.setdefault(r[4], []).append(r[0])
    return sorted(bins.values())


def test_packing_obeys_conflicts():
    docs = [(i, f"s{rng.randrange(6)}" if i % 11 else None, rng.randrange(80) if i % 3 else 7, rng.randrange(1, 260)) for i in range(400)]
    rows = packing.pack_group(docs, 100)
    check_packing(rows, {d[0]: d[3] for d in docs}, {d[0]: d[1] for d in docs}, {d[0]: d[2] for d in docs}, 100)


@pytest.mark.parametrize("clusters", [10_000, 60])
def test_packing_gives_the_bins_of_plain_best_fit(clusters):
    docs = [(i, f"s{rng.randrange(9)}" if i % 7 else None, rng.randrange(clusters) if i % 5 else None, rng.randrange(1, 100)) for i in range(400)]
    assert packed_bins(docs, 100) == slow_best_fit(docs, 100)


def test_packing_of_tables(spark, docs):
    from pyspark.sql import functions as F

    odd = docs.withColumn("source", F.when(F.col("doc_id") != 3, "src")).withColumns({c: F.lit(7) for c in ("length", "cluster", "piece", "tie", "root")})
    odd = odd.unionByName(odd.limit(0)).unionByName(spark.createDataFrame([(None, None, "s", 0, None, 1, 1, 1, 1, 1), (5, TEXTS[5][1], "s", 0, "src", 1, 1, 1, 1, 1)], odd.schema))
    rows = packing.pack_documents(odd, capacity=64, group=5).collect()
    lengths, got = {}, {}
    for d, t in [*TEXTS, (None, None), TEXTS[5]]:
        lengths[d] = lengths.get(d, 0) + len((t or "").split()) + 1
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == lengths
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_bins_hold_one_of_each_group_of_near_copies_and_source(spark):
    base = prose(120)
    texts = [base, base, base + " more", *(prose(30) for _ in range(40))]
    docs = spark.createDataFrame([(d, t, f"s{d % 11}") for d, t in enumerate(texts)], "doc_id long, text string, source string")
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, capacity=4000, tokenizer_path=path).collect()
    from tokenizers import Tokenizer

    want = {d: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for d, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    for found in bins.values():
        assert sum(d < 3 for d in found) <= 1 and len({d % 11 for d in found}) == len(found)


def test_groups_are_as_large_as_they_say(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id as doc_id", "cast(id % 50 as string) as source", "cast(null as long) as cluster", "10 as length")
    got = packing.pack(rows, 100, 100).selectExpr("bin_id >> 32 as deal").groupBy("deal").count().collect()
    assert len(got) == 40 and max(r["count"] for r in got) < 200


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs():
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 30))], [rng.randrange(6) for _ in range(rng.randrange(40))]
        assert decontaminate.lcs(a, b) == slow_lcs(a, b)


def test_leaks_and_paraphrases_are_found(spark):
    items = [(i, f"{prose(20)}. {prose(12)}.") for i in range(12)] + [(50, None), (51, "two words")]
    hurt = lambda t, k: " ".join(w for j, w in enumerate(t.split()) if j % k)
    texts = [(i, f"{prose(70)} {items[i][1]} {prose(40)}") for i in range(4)] + [(10 + i, f"{prose(30)} {hurt(items[i][1], 8)} {prose(50)}") for i in range(4, 8)] + [(30 + i, prose(120)) for i in range(20)] + [(90, None), (91, ""), (None, prose(30)), (92, "two words")]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in texts], "doc_id long, text string, cosine double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(i, i) for i in range(4)} | {(10 + i, i) for i in range(4, 8)}
    assert decontaminate.drop_leaks(docs, bench).count() == len(texts) - 8
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = queries.table(spark, SF, "documents")
    labels = {r.doc_id: r for r in queries.table(spark, SF, "labels").collect()}
    rows, columns = docs, docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in rows.collect()}
        rows = step(spark, rows, SF).persist()
        assert rows.columns == columns
        after = {r.doc_id for r in rows.collect()}
        assert after <= set(before) and after
        if name == "quality":
            clean = [d for d in before if d in labels and labels[d].quality == 1]
            assert sum(d in after for d in clean) > 0.95 * len(clean)
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in rows.collect()}


def slow_stages(rows, labels, spark):
    """What stays of ``rows (doc_id, text)`` after the first two stages, by plain Python over all rows."""
    scored = quality_model.score_rows(rows, labels).collect()
    bad = {(r.doc_id, r.tie) for r in scored if r.predicted == 0 and r.doc_id is not None}
    good = [r for r in rows.selectExpr("*", "xxhash64(coalesce(text, '')) as tie").collect() if (r.doc_id, r.tie) not in bad]
    prints = [simhash.fingerprint(r.text or "") for r in good]
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    names = {}
    for r, g in zip(good, group):
        if r.doc_id is not None:
            names[g] = min(names.get(g, r.doc_id), r.doc_id)
    kept, seen = [], {}
    for r, g in sorted(zip(good, group), key=lambda x: (x[0].tie, str(x[0]))):
        if r.doc_id is None:
            kept.append(r)
        elif r.doc_id == names[g] and seen.setdefault((r.doc_id, g), r) is r:
            kept.append(r)
    return [(r.doc_id, r.text) for r in good], [(r.doc_id, r.text) for r in kept]


def test_pipeline_of_odd_rows_equals_plain_stages(spark, tmp_path):
    from pyspark.sql import functions as F

    near = prose(90)
    odd = [(1, near), (1, prose(60)), (1, near), (2, near), (2, prose(70)), (3, near + " x"), (None, near), (None, None), (4, None), (5, ""), (6, prose(20_000)), (7, prose(50)), (7, None)]
    base = queries.table(spark, SF, "documents").limit(60)
    docs = base.select(F.col("doc_id") + 100, "text", *base.columns[2:]).toDF(*base.columns)
    docs = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(f.name).cast(f.dataType) for f in docs.schema]))
    docs = docs.withColumns({"fp": F.lit(1), "_root": F.lit("x"), "tie": F.lit(2), "root": F.lit(3), "cluster": F.lit(4)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    queries.table(spark, SF, "labels").withColumn("doc_id", F.col("doc_id") + 100).write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (queries.table(spark, str(tmp_path), t) for t in ("documents", "labels"))
    good, kept = slow_stages(docs, labels, spark)
    first = corpus_pipeline.quality(spark, docs, str(tmp_path)).persist()
    assert sorted(map(str, ((r.doc_id, r.text) for r in first.collect()))) == sorted(map(str, good))
    second = corpus_pipeline.near_copies(spark, first, str(tmp_path))
    assert sorted(map(str, ((r.doc_id, r.text) for r in second.collect()))) == sorted(map(str, kept))
    assert second.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {d for d, _ in kept} and len(out) > 10
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_quality_keeps_what_scores_say_without_exchanging_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(3).select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars").unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(odd).withColumn("f0", F.lit("more"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    scored = quality_model.score_rows(docs, labels).collect()
    good = {(r.doc_id, r.tie) for r in scored if r.predicted == 1}
    got = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.dtypes == docs.dtypes
    want = [r for r in docs.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).collect() if r.doc_id is None or (r.doc_id, r.tie) in good]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)[:-1]) for r in want)
    assert 0 < len(want) < docs.count()
