from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrec.llm import quality_model, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(3, "b c d e f", "en", 1), (None, "no id here", "en", 1), (1, None, None, 1), (2, "", "en", None), (3, "b c d e f", "en", 1), (9, "wörd " * 20000, "xx", 1), (10, "x" * 5000, "en", 1)]
SCHEMA = "doc_id long, text string, lang string, score int"


def slow_counts(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines, dup, had = text.split("\n"), 0, set()
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in had
        had.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts_equal_a_plain_count(spark):
    rows = [r.text or "" for r in queries.table(spark, SF, "documents").select("text").limit(300).collect()] + [r[1] or "" for r in ODD] + ["a b c d e a b c d e\na\n\na", "a a a a a a a", " \n \n", "x y z\x1cq"]
    for text in rows:
        assert quality_rules.base_counts(text, text.encode().split()) == slow_counts(text)


def test_distance():
    p = np.array([0.5, 0.5, 0.0])
    assert quality_rules.distance(p, p) == 0 and quality_rules.distance(p, np.array([0, 0, 1.0])) == 1
    assert quality_rules.distance(p, np.array([[0.5, 0.5, 0], [1, 0, 0]])).shape == (2,)


def test_rules_keep_clean_and_drop_junk(spark):
    found = queries.op3_quality_divergence(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id")
    got = {r["quality"]: r for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((~F.col("base_failed") & ~F.col("kept")).cast("int")).alias("ours")).collect()}
    assert got[1]["ours"] <= 0.01 and got[0]["kept"] < 0.5


def slow_verdicts(rows, spread=quality_rules.SPREAD, least=quality_rules.LEAST):
    """``kept`` of ``rows (doc_id, text, lang)`` by plain counting."""
    import math
    import re
    import unicodedata

    def classes(text):
        found = Counter()
        for c in text:
            kind = unicodedata.category(c)[0]
            if c.isspace() or c in "#*$%&|<>":
                found["space" if c.isspace() else "S"] += 1
            elif kind == "L" and ord(c) < 0x250:
                found["accented" if ord(c) > 127 else "upper" if c.isupper() else "lower"] += 1
            else:
                found[{"Z": "space"}.get(kind, kind)] += 1
        return found

    def js(p, q):
        total = 0.0
        for k in {*p, *q}:
            a, b = p.get(k, 0.0), q.get(k, 0.0)
            total += sum(x * math.log2(2 * x / (a + b)) / 2 for x in (a, b) if x)
        return math.sqrt(max(total, 0.0))

    share = lambda c: {k: v / sum(c.values()) for k, v in c.items()}
    texts = [(d, t or "", lang) for d, t, lang in rows]
    words = {d: [w for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for d, t, _ in texts}
    lower = {d: [w.decode() for w in t.lower().encode().split()] for d, t, _ in texts}
    failed = {d: len(words[d]) < 10 or 100 * slow_counts(t)[4] > 20 * len(words[d]) for d, t, _ in texts}
    log = lambda n: int(math.log2(max(1, n)))

    def bounds(of):
        """Lists of distances by length -> bound of each length, at least 20 distances in a group."""
        parts, mine, held = [], [], []
        for length in sorted(of):
            mine, held = mine + [length], held + of[length]
            if len(held) >= 20:
                parts.append((mine, held))
                mine, held = [], []
        if mine:
            parts = [(parts[-1][0] + mine, parts[-1][1] + held)] if len(parts) == 1 else [*parts[:-1], (parts[-1][0] + mine, parts[-1][1] + held)] if parts else [(mine, held)]
        out, least_yet = {}, math.inf
        for mine, held in parts:
            held = sorted(held)
            at = lambda s: held[max(0, math.ceil(s * len(held)) - 1)]  # noqa: E731, B023
            least_yet = min(least_yet, at(0.5) + spread * max(at(0.5) - at(0.1), least))
            out |= dict.fromkeys(mine, least_yet)
        return out

    rough = lambda t: share(Counter({"text": sum(n for k, n in classes(t).items() if k in ("lower", "upper", "accented", "L", "M", "space"))}) + Counter({k: n for k, n in classes(t).items() if k in "NPS"}) + Counter({"other": sum(n for k, n in classes(t).items() if k == "C")}))
    long_ones = {t for _, t, _ in texts if len(t) >= 400}
    mean = Counter()
    for t in long_ones:
        for k, v in rough(t).items():
            mean[k] += v / len(long_ones)
    away = {t: round(js(rough(t), mean) * 1000) / 1000 for t in long_ones}
    by_length = {}
    for t in long_ones:
        by_length.setdefault(log(len(t)), []).append(away[t])
    usual_bounds = bounds(by_length)
    usual = {t: t not in long_ones or away[t] <= usual_bounds[log(len(t))] + 0.0005 for _, t, _ in texts}
    of, shapes, behind = {}, {}, {}
    for d, t, lang in texts:
        if not failed[d] and usual[t]:
            of.setdefault(lang, Counter()).update(lower[d])
            shapes.setdefault(lang, Counter()).update(classes(t))
            behind.setdefault(lang, set()).add(t)
    refs = {}
    for lang, count in of.items():
        n = sum(count.values())
        if n and len(behind[lang]) >= 20:
            top = sorted(((w, k) for w, k in count.items() if k >= n * 1e-4), key=lambda x: (-x[1], x[0]))[:60]
            refs[lang] = {w: k / sum(k for _, k in top) for w, k in top}
    measures = {}
    for d, t, _ in texts:
        far = [], []
        if len(words[d]) >= 50:
            far[0].extend((js(share(Counter(w for w in lower[d] if w in ref)), ref) if set(lower[d]) & set(ref) else 1.0, lang) for lang, ref in refs.items())
        if len(t) >= 400:
            far[1].extend((js(share(classes(t)), share(shapes[lang])), lang) for lang in refs)
        measures[d] = t, min(far[0], default=None, key=lambda x: x[0]), min(far[1], default=None, key=lambda x: x[0]), len(words[d]), sum(map(len, words[d]))
    ok = {d: not failed[d] for d in measures}
    near_enough = dict.fromkeys(measures, True)
    for which, size in ((1, 3), (2, 4)):
        groups, everywhere = {}, {}
        distinct = {m[0]: m for d, m in measures.items() if m[which] and not failed[d]}.values()
        for m in distinct:
            groups.setdefault(m[which][1], {}).setdefault(log(m[size]), []).append(round(m[which][0] * 1000) / 1000)
            everywhere.setdefault(log(m[size]), []).append(round(m[which][0] * 1000) / 1000)
        for d, m in measures.items():
            if m[which] and not failed[d]:
                own = groups[m[which][1]]
                near_enough[d] &= m[which][0] <= bounds(own if sum(map(len, own.values())) >= 20 else everywhere)[log(m[size])] + 0.0005
    for d, t, lang in texts:
        ok[d] &= near_enough[d] if lang in refs else usual[t]
    return ok


def test_verdicts_equal_plain_counting(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text", "lang").limit(400).collect()]
    rows += [(10**6, " ".join(f"слово{i % 37}" for i in range(80)), "ru"), (10**6 + 1, "\U0001f600" * 500 + " a" * 60, "en"), (10**6 + 2, "qzx " * 3 + " ".join(f"zq{i}x" for i in range(300)), "en"), (10**6 + 3, None, None)]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == slow_verdicts(rows)


def test_rare_language_code_opens_no_door(spark):
    """Junk under a code of its own neither passes nor lets like texts through."""
    rng = __import__("random").Random(8)
    odd = ["%%$#" + str(rng.randrange(10**6)) + "|<>" for _ in range(30)]
    junk = [(10**6 + i, " ".join(rng.sample(odd, 30) + [f"{rng.randrange(10**9)}" for _ in range(60)]), "zz" if i < 2 else "en") for i in range(8)]
    docs = queries.table(spark, SF, "documents").select("doc_id", "text", "lang")
    got = quality_rules.judge_quality(docs.union(spark.createDataFrame(junk, docs.schema)))
    assert got.filter("doc_id >= 1000000 and kept").count() == 0
    assert got.filter("doc_id >= 1000000 and base_failed").count() == 0


def test_small_languages_are_judged_by_their_own_and_strange_texts_are_turned_away(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text", "lang")
    rng = __import__("random").Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    plain = lambda letters: ". ".join(" ".join(word(letters) for _ in range(9)) for _ in range(12))
    more = spark.createDataFrame([(10**6, plain("авгдеиклмнопрст"), "ru"), (10**6 + 1, plain("qzxjwk"), "en"), (10**6 + 2, plain("\U0001f600\U0001f601\U0001f602"), "en")], docs.schema)
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(docs.union(more)).filter("doc_id >= 1000000").collect()}
    assert got == {10**6: True, 10**6 + 1: False, 10**6 + 2: False}


@pytest.mark.parametrize("judge", [lambda s, d: quality_rules.judge_quality(d), lambda s, d: quality_model.score_quality(d, s), lambda s, d: toxicity.score_toxicity(d, s)])
def test_odd_rows_are_judged(spark, judge):
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 1), (None, 0, 0), (9, 0, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = judge(labels, docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    for r in rows:
        assert not hasattr(r, "score") or 0 <= r.score <= 1
    assert judge(labels, docs.limit(0)).count() == 0
    assert judge(labels.limit(0), docs).count() == len(ODD)


def held_out(df, labels, column):
    rows = df.filter("held_out").join(labels, "doc_id").select(F.col(column).alias("y"), "predicted", "score").collect()
    right = [r for r in rows if r.y == 1]
    wrong = [r for r in rows if r.y == 0]
    return np.mean([r.predicted for r in right]), np.mean([r.predicted for r in wrong])


def test_quality_on_held_out_rows(spark):
    good, bad = held_out(queries.op5_quality_discriminant(spark, SF), queries.table(spark, SF, "labels"), "quality")
    assert good > 0.97 and bad < 0.1


def test_quality_scores_equal_plain_densities(spark):
    """Scores against the discriminant written out with NumPy over all labelled rows, means and covariances by its own functions."""
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    rows = {r.doc_id: quality_model.statistics(r.text or "") for r in docs.select("doc_id", "text").collect()}
    marks = {r.doc_id: r.quality for r in labels.filter("quality is not null").collect()}
    train = [d for d in rows if d in marks and __import__("zlib").crc32(str(d).encode()) % 5]
    x, y = np.array([rows[d] for d in train]), np.array([marks[d] for d in train])
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(covs))
    log = []
    for k, cov in enumerate(covs):
        shrunk = 0.9 * cov + 0.1 * pooled
        shrunk = 0.9 * shrunk + 0.1 * np.diag(np.diag(shrunk)) + 1e-3 * np.eye(len(cov))
        left = np.array(list(rows.values())) - x[y == k].mean(0)
        log.append(-0.5 * np.sum(left @ np.linalg.inv(shrunk) * left, 1) - 0.5 * np.linalg.slogdet(shrunk)[1] + np.log((y == k).mean()))
    want = dict(zip(rows, 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / 20, -500, 500)))))
    got = {r.doc_id: r for r in queries.op5_quality_discriminant(spark, SF).collect()}
    assert all(abs(got[d].score - s) < 1e-6 and got[d].predicted == (got[d].score >= 0.3) for d, s in want.items())


def test_toxicity_on_held_out_rows(spark):
    caught, false = held_out(queries.op10_toxicity_kernel(spark, SF), queries.table(spark, SF, "labels"), "toxic")
    assert caught > 0.5 and false < 0.05


def test_kernel_tolerates_gaps():
    rng = __import__("random").Random(1)
    clean = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 10))) for _ in range(800)]
    model = toxicity.learn(["idiot", "stupid", "moron", "idiots", "stupidly", "moronic"], clean)
    decide = lambda t: float(toxicity.Scorer(model).decide([t])[0])
    assert decide("you id.iot") > 0 and decide("such a st*upid thing") > 0 and decide("m o r o n") > 0 and decide("MORON!") > 0
    assert decide("a table in the garden") < 0


def test_folds_are_crc32_of_the_id_as_text(spark):
    import zlib

    got = {r[0]: r[1] for r in spark.range(50).select("id", quality_model.fold_of(F.col("id"), 5)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def plain_kernel(a, b):
    """The kernel of two words by its definition: every subsequence of three letters (a start sign before the first) of both."""

    def parts(word):
        found, letters = Counter(), toxicity._codes([word], len(word))[0].tolist()
        for i, j, k in __import__("itertools").combinations(range(len(letters)), 3):
            if k - i < toxicity.SPAN:
                found[letters[i], letters[j], letters[k]] += toxicity.DECAY ** (k - i + 1)
        norm = toxicity._norm(len(word))
        return {s: x / norm for s, x in found.items()}

    x, y = parts(a), parts(b)
    return sum(v * y.get(s, 0.0) for s, v in x.items())


def test_the_table_is_the_machine_over_the_plain_kernel():
    rng = __import__("random").Random(2)
    word = lambda: "".join(rng.choice("abcdefgh.-") for _ in range(rng.randrange(1, 9))).strip(".-") or "a"
    marks = [[word() for _ in range(3)] for _ in range(12)]
    shown = [[word() for _ in range(3)] for _ in range(20)]
    k = lambda s, t: sum(plain_kernel(a, b) for a in s for b in t)
    gram = np.array([[k(s, t) for t in marks] for s in marks])
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-6 * values.max()
    plain = np.array([[k(s, t) for t in marks] for s in shown]) @ (vectors[:, kept] / np.sqrt(values[kept]))
    got = toxicity.sentence_values(shown, toxicity.nystroem(marks))
    assert np.allclose(plain @ plain.T, got @ got.T, rtol=1e-3, atol=1e-3)
    weights = np.arange(1.0, got.shape[1] + 1)
    table = toxicity.nystroem(marks) @ weights
    decide = toxicity.Scorer({"table": table, "offset": 0.5}).decide([" ".join(s) for s in shown])
    assert np.allclose(decide, got @ weights + 0.5, rtol=1e-3, atol=1e-2)


def test_planted_insults_are_caught_and_clean_texts_left_alone(spark):
    rng = __import__("random").Random(5)
    common = ["".join(rng.choice("aeioustrnmlcdp") for _ in range(rng.randrange(2, 10))) for _ in range(800)]
    insults = ["zwackel", "brumfitz", "quorgo", "vlaxnit"]
    rows, labels = [], []
    for d in range(1500):
        words, toxic = [rng.choice(common) for _ in range(rng.randrange(30, 160))], d % 5 == 0
        for _ in range(2 if toxic else 0):
            insult = rng.choice(insults)
            at = rng.randrange(1, len(insult))
            words.insert(rng.randrange(len(words)), insult if rng.random() < 0.6 else insult[:at] + rng.choice(".-*xe") + insult[at:])
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    caught, false = held_out(toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels), labels, "toxic")
    assert caught >= 0.95 and false <= 0.02
