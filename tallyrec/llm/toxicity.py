"""Toxicity by a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums, over all subsequences of three characters within a
span of ``SPAN``, the products of their weights ``DECAY ** span``; so "id.iot" still
shares most of what "idiot" has.  The kernel of two sentences sums it over their words.
Landmark sentences give the Nystroem map ``k(x, landmarks) K ** -1/2``; a linear support
vector machine is trained on it by Newton steps.  As three-character subsequences are
countable, the machine's whole decision collapses into one table of subsequence
weights, and a sentence is scored by looking its words' subsequences up.

A sentence is ``SENTENCE`` words in a row.  Only texts have labels, and one sentence can
make a text toxic, so the machine is trained in rounds, on sentences: of every toxic text
the one that the machine before takes for the most toxic, gapped variants of those,
sentences drawn from clean texts, and the clean ones that the machines before took for toxic.
Before the first round there is no machine; there a text's sentence is the one around the word that
(or a beginning of which) is most over-represented in toxic texts, by smoothed counts of texts.

Training texts: labelled documents of the training folds, of which at most
``TRAIN_DOCS`` (a documented bound, chosen by hash) are read.  A quarter of them, chosen
by hash as well, is set aside: a logistic regression over a text's highest sentence, its
three highest (that don't overlap) and its length turns decisions into scores there, with
both classes weighing alike.  Every sentence of every whole text is scored.

Cases: null and empty texts score as if no sentence had been found; labels
that are null are passed over, and a document labelled twice is toxic if any label
says so; a score of just the threshold counts as toxic; repeated rows get the same score;
without examples of both classes all scores are the training share.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrec.llm.common import stage, text_or_empty
from tallyrec.llm.quality_model import fold_of

DECAY, SPAN = 0.6, 8
#: Words of a sentence.
SENTENCE = 3
#: Labelled documents that the model is trained on, at most; a share of them is set aside for the scores.
TRAIN_DOCS, ASIDE = 20_000, 4
#: Landmarks; drawn clean sentences and those taken for toxic in a round, at most.
LANDMARKS, DRAWN, MINED = 480, 8000, 3000
#: Words and beginnings that the first sentences are found by, at most, and the weight of the smoothing in texts.
EVIDENCE, SMOOTH = 50_000, 2.0
STEMS = (4, 5, 6, 7)
ROUNDS = 4
COST = 10.0
#: Slope of the scores where the set-aside texts have only one class.
SLOPE = 5.0
FOLDS = 3
#: Tokens longer than this are read in overlapping windows.
WINDOW = 24
#: Training texts of a task, about.
TASK_DOCS = 1000
#: Distinct tokens a task remembers the values of.
CACHE = 300_000
SPACED = re.compile(r"(?<!\S)(?:\w[ .\-_*]){3,}\w(?!\S)")

#: Code points to kernel letters: 0 is padding, 1 the start, 2 to 27 a-z, then digits, other letters, other.
LETTERS = 31
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def plain(tokens: list[str]) -> list[str]:
    """Lower case, no accents, look-alikes as letters, nothing but letters and digits at the ends."""
    text = unicodedata.normalize("NFKD", "\n".join(tokens).lower().replace("ß", "ss"))
    text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    found = [t.strip(".,;:!?*#%&|<>()[]{}\"'-_+=~^`/\\") for t in text.split("\n")]
    return [t.translate(_LOOKALIKE) if not t.isalpha() and not t.isdigit() else t for t in found]


def _codes(tokens: list[str], width: int) -> np.ndarray:
    """A row of kernel letters for each token, padded with 0."""
    table = np.full(129, 30, np.int64)
    table[97:123] = np.arange(2, 28)
    table[48:58] = 28
    table[128] = 29
    table[0] = 0
    padded = "".join(t.ljust(width, "\0") for t in tokens)
    points = np.frombuffer(padded.encode("utf-32-le", "replace"), np.uint32)
    rows = table[np.minimum(points, 128)].reshape(len(tokens), width)
    return np.concatenate([np.ones((len(tokens), 1), np.int64), rows], axis=1)


def _norm(length: int) -> float:
    """A token's scale: the root of its subsequences' squared weights, which its length gives."""
    total = sum(DECAY ** (2 * (k + 1)) * (k - 1) * max(0, length + 1 - k) for k in range(2, SPAN))
    return max(total, 1e-9) ** 0.5


def spans(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(subsequence numbers at every start, weight) for each shape of gaps; 0 where it runs into padding."""
    width = codes.shape[1]
    for k in range(2, min(SPAN, width)):
        last = codes[:, k:]
        for j in range(1, k):
            first, second = codes[:, : width - k], codes[:, j : width - k + j]
            yield np.where(last > 0, (first * LETTERS + second) * LETTERS + last, 0), DECAY ** (k + 1)


def windows(token: str) -> list[str]:
    return [token] if len(token) <= WINDOW else [token[i : i + WINDOW] for i in range(0, len(token) - WINDOW // 2, WINDOW // 2)]


def look_up(tokens: list[str], table: np.ndarray) -> np.ndarray:
    """The scaled sum of each token's weights in ``table`` (one column, or several)."""
    out = np.zeros((len(tokens), *table.shape[1:]), np.float64)
    sizes = np.array([len(t) for t in tokens])
    edges = [0, 5, 7, 9, 12, 16, 20, WINDOW]
    held = max(1, 400_000 // int(np.prod(table.shape[1:])))
    for small, large in zip(edges, edges[1:], strict=False):
        some = np.flatnonzero((sizes > small) & (sizes <= large))
        for at in (some[i : i + held] for i in range(0, len(some), held)):
            codes = _codes([tokens[i] for i in at], large)
            total = sum(table[numbers].sum(1) * weight for numbers, weight in spans(codes))
            out[at] = total / np.array([_norm(int(s)) for s in range(large + 1)])[sizes[at]].reshape(-1, *[1] * (table.ndim - 1))
    return out


def gapped(token: str, rng: random.Random) -> str:
    """The token with one or two characters put in, or with one separator throughout."""
    if rng.random() < 0.4:
        return rng.choice(".-*_").join(token)
    for _ in range(rng.choice((1, 1, 2))):
        at = rng.randrange(1, len(token))
        token = token[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz.-*_") + token[at:]
    return token


def machine(x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, by Newton steps over blocks of rows."""
    share = cost * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    blocks = [slice(i, i + 4096) for i in range(0, len(y), 4096)]
    with_one = lambda at: np.column_stack([x[at].astype(float), np.ones(len(x[at]))])
    ridge = np.eye(x.shape[1] + 1)
    ridge[-1, -1] = 1e-6
    w, active = np.zeros(x.shape[1] + 1), np.ones(len(y), bool)
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(len(w))
        for at in blocks:
            mine = with_one(at)[active[at]]
            scaled = mine * share[at][active[at], None]
            left += scaled.T @ mine
            right += scaled.T @ y[at][active[at]]
        w = np.linalg.solve(left, right)
        now = np.concatenate([y[at] * (with_one(at) @ w) < 1 for at in blocks])
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def sentence_table(sentences: list[list[str]]) -> np.ndarray:
    """Each sentence's own subsequence weights, one column a sentence."""
    table = np.zeros((LETTERS**3, len(sentences)), np.float32)
    for i, sentence in enumerate(sentences):
        for word in sentence:
            for numbers, weight in spans(_codes([word], len(word))):
                np.add.at(table, (numbers.ravel(), i), weight / _norm(len(word)))
    table[0] = 0
    return table


def sentence_values(sentences: list[list[str]], table: np.ndarray) -> np.ndarray:
    """The sum of each sentence's words' values."""
    out = np.zeros((len(sentences), *table.shape[1:]), np.float32)
    for at in range(0, len(sentences), 2000):
        words = list(dict.fromkeys(w for s in sentences[at : at + 2000] for w in s))
        of, place = look_up(words, table), {w: i for i, w in enumerate(words)}
        out[at : at + 2000] = [of[[place[w] for w in s]].sum(0) for s in sentences[at : at + 2000]]
    return out


def nystroem(landmarks: list[list[str]]) -> np.ndarray:
    """Table of the map ``k(x, landmarks) K ** -1/2``."""
    table = sentence_table(landmarks)
    values, vectors = np.linalg.eigh(sentence_values(landmarks, table).astype(float))
    kept = values > 1e-6 * values.max()
    return table @ (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)


def _some(rng: random.Random, found: list, n: int) -> list:
    return found if len(found) <= n else rng.sample(found, n)


def words_in(sentence: str) -> list[str]:
    """A sentence's plain words, as long as the kernel takes them."""
    return [w[:WINDOW] for w in plain(sentence.split()) if w]


def learn(positive: list[str], negative: list[str], seed: int = 7, before: np.ndarray | None = None) -> dict:
    """The decision table of a machine trained on these sentences; ``before`` is the table of the round before."""
    rng = random.Random(seed)
    toxic = [w for w in map(words_in, positive) if w]
    clean = [w for w in map(words_in, negative) if w]
    marks = _some(rng, toxic, LANDMARKS // 2) + _some(rng, clean, LANDMARKS // 2)
    known = list(dict.fromkeys(w for s in toxic for w in s))
    value = dict(zip(known, look_up(known, before) if before is not None else map(len, known), strict=True))
    hurt = []
    for s in toxic:
        worst = max(s, key=lambda w: (value[w], w))
        if len(worst) > 3:
            hurt += [[gapped(w, rng)[:WINDOW] if w == worst else w for w in s] for _ in range(2)]
    hurt += [[gapped(w, rng)[:WINDOW] if len(w) > 3 else w for w in s] for s in clean[: len(clean) // 3]]
    table = nystroem(marks)
    x = sentence_values(toxic + clean + hurt, table)
    y = np.full(len(x), -1.0)
    y[: len(toxic)] = y[len(toxic) + len(clean) : len(x) - len(clean) // 3] = 1
    weights, offset = machine(x, y)
    return {"table": (table @ weights).astype(np.float32), "offset": offset}


def tokens_of(text: str) -> list[str]:
    """Words, and runs of single characters read as one word."""
    found = text.split()
    spaced = SPACED.findall(text)
    return found + [re.sub(r"[ .\-_*]", "", s) for s in spaced] if spaced else found


class Scorer:
    """Decisions of texts; the values of words are remembered."""

    def __init__(self, model: dict):
        self.table, self.offset, self.known = model["table"], model["offset"], {}

    def _learn_words(self, words: set[str]) -> None:
        fresh = [t for t in words if t not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = list(words)
        if not fresh:
            return
        parts, owner, value = [], [], np.full(len(fresh), -np.inf)
        for i, word in enumerate(plain(fresh)):
            for part in windows(word) if word else ():
                parts.append(part), owner.append(i)
        if parts:
            np.maximum.at(value, np.array(owner), look_up(parts, self.table))
        # mere marks are no words of a sentence
        self.known.update(zip(fresh, [None if v == -np.inf else v for v in value.tolist()], strict=True))

    def sentences(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Each text's words and the decisions of its sentences, by their first word."""
        for at in range(0, len(texts), 256):
            each = [tokens_of(t) for t in texts[at : at + 256]]
            self._learn_words(set().union(*each))
            for words in each:
                found = [(w, v) for w in words if (v := self.known[w]) is not None]
                total = np.cumsum([0.0, *(v for _, v in found)])
                n = min(SENTENCE, len(found))
                yield [w for w, _ in found], total[n:] - total[: len(total) - n] + self.offset if n else np.array([self.offset])

    def decide(self, texts: list[str]) -> list[float]:
        """The highest decision of each text's sentences; the offset alone where there are none."""
        return [float(d.max()) for _, d in self.sentences(texts)]

    def measure(self, texts: list[str]) -> np.ndarray:
        """What scores are made of: the highest decision, the mean of three that don't overlap, the length."""
        out = np.zeros((len(texts), 3))
        for i, (words, d) in enumerate(self.sentences(texts)):
            d, best = d.copy(), []
            for _ in range(3):
                k = int(d.argmax())
                if d[k] == -np.inf:
                    break
                best.append(d[k])
                d[max(0, k - SENTENCE + 1) : k + SENTENCE] = -np.inf
            out[i] = best[0], sum(best) / len(best), np.log1p(len(words))
        return out


def _draw_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sentence of each text, drawn by the text's hash."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        found = []
        for cell in batch["text"]:
            words = tokens_of(cell.as_py())
            words = [w for w, p in zip(words, plain(words), strict=True) if p]
            at = xxh3_64_intdigest(cell.as_py()) % max(1, len(words) - SENTENCE + 1)
            found.append(" ".join(words[at : at + SENTENCE]))
        yield pa.RecordBatch.from_arrays([batch["label"], batch["tie"], pa.array(found, pa.string())], ["label", "tie", "sentence"])


def stems_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:n] for n in STEMS if n < len(word))]


def _unit_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many clean and toxic texts each word or beginning is."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for cell, label in zip(batch["text"], batch["label"].to_pylist(), strict=True):
            for unit in {s for w in plain(list(set(tokens_of(cell.as_py())))) if len(w) > 2 for s in stems_of(w[:WINDOW])}:
                counts.setdefault(unit, [0, 0])[label] += 1
        if counts:
            clean, toxic = zip(*counts.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["unit", "clean", "toxic"])


def _first_tasks(evidence: dict[str, float]):
    """The sentence around each text's word of most evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell in batch["text"]:
                words = tokens_of(cell.as_py())
                words = [(w, p) for w, p in zip(words, plain(words), strict=True) if p]
                worth = [max(evidence.get(s, 0.0) for s in stems_of(p[:WINDOW])) for _, p in words]
                at = max(0, min(worth.index(max(worth)) - SENTENCE // 2, len(words) - SENTENCE)) if words else 0
                found.append(" ".join(w for w, _ in words[at : at + SENTENCE]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["sentence"])

    return run


def _best_tasks(model: dict):
    """The most toxic sentence of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            best = [(" ".join(words[k : k + SENTENCE]), float(d[k])) for words, d in scorer.sentences([t.as_py() for t in batch["text"]]) for k in [int(d.argmax())]]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64())], ["label", "sentence", "decision"])

    return run


def _measure_tasks(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = scorer.measure([t.as_py() for t in batch["text"]])
            yield pa.RecordBatch.from_arrays([batch["label"], *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["label", "f0", "f1", "f2"])

    return run


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes (and an offset, last) of a ridged logistic regression in which both classes weigh alike."""
    if not 0 < y.sum() < len(y):
        return np.array([SLOPE, 0.0, 0.0, 0.0])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    x1, share = np.column_stack([(x - mean) / spread, np.ones(len(x))]), np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -50, 50)))
        w += np.linalg.solve((x1 * (share * p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(len(w)), x1.T @ (share * (y - p)) - 0.1 * w)
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def fit(docs: DataFrame, labels: DataFrame, *, folds: int, held_out_fold: int, train_docs: int = TRAIN_DOCS) -> dict:
    """A model from the labelled documents of the training folds."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    train = known.filter(fold_of(F.col("doc_id"), folds) != held_out_fold)
    chosen = stage(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs), "toxic-training")
    sizes = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return {"constant": share}
    # at most train_docs ids, so they can go to every task
    texts = docs.select("doc_id", text_or_empty()).join(F.broadcast(chosen), "doc_id").select("text", "label", F.xxhash64("text").alias("tie"))
    texts = stage(texts.dropDuplicates(["text", "label"]).repartition(max(1, -(-total // TASK_DOCS)), "tie"), "toxic-texts")
    aside = F.pmod(F.xxhash64("tie"), F.lit(ASIDE)) == 0
    mine, rest = texts.filter(~aside), texts.filter(aside)
    drawn = mine.filter("label = 0").mapInArrow(_draw_tasks, "label int, tie long, sentence string").filter("sentence <> ''")
    clean = [r["sentence"] for r in drawn.orderBy("tie").limit(DRAWN).collect()]
    units = mine.mapInArrow(_unit_tasks, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = F.log((F.col("toxic") + SMOOTH * share) / (F.col("toxic") + F.col("clean") + SMOOTH) / share).alias("lift")
    strong = units.filter("toxic > 1").select("unit", lift).orderBy(F.desc("lift"), "unit").limit(EVIDENCE).collect()
    first = mine.filter("label = 1").mapInArrow(_first_tasks({r["unit"]: r["lift"] for r in strong}), "sentence string").filter("sentence <> ''")
    positive = [r["sentence"] for r in first.orderBy("sentence").collect()]
    if not positive or not clean:
        return {"constant": share}
    negative = dict.fromkeys(clean)
    model = learn(positive, clean)
    for _ in range(ROUNDS):
        best = stage(mine.mapInArrow(_best_tasks(model), "label int, sentence string, decision double").filter("sentence <> ''"), "toxic-best")
        positive = [r["sentence"] for r in best.filter("label = 1").orderBy("sentence").collect()]
        negative |= dict.fromkeys(r["sentence"] for r in best.filter("label = 0").orderBy(F.desc("decision"), "sentence").limit(MINED).collect())
        model = learn(positive, list(negative), before=model["table"])
    rows = rest.mapInArrow(_measure_tasks(model), "label int, f0 double, f1 double, f2 double").collect()
    return model | {"slopes": calibrate(np.array([r[1:] for r in rows], float).reshape(-1, 3), np.array([r["label"] for r in rows], float))}


def _score_tasks(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if "constant" in model else Scorer(model)
        for batch in batches:
            if scorer is None:
                score = np.full(len(batch), model["constant"])
            else:
                at = scorer.measure([t.as_py() for t in batch["text"]]) @ model["slopes"][:-1] + model["slopes"][-1]
                score = 1 / (1 + np.exp(-np.clip(at, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held_out_fold: int = 1, threshold: float = 0.7, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit(docs, labels, folds=folds, held_out_fold=held_out_fold, train_docs=train_docs)
    scored = docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(_score_tasks(model), "doc_id long, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
