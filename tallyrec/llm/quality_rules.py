"""Quality rules with distribution divergence.

Every document gets base counts and two histograms: of its characters by class and
of the most common words of a language among its words (the others aren't a bin, which
would make all texts alike in most of their words).  Both are held against each language's reference by the Jensen-Shannon
distance (square root, base 2; 0 equal, 1 disjoint); the nearest language counts.
A document is turned away if it fails the base rule, or if a histogram that has
enough in it (``MIN_CHARS``, ``MIN_WORDS``) is too far from every language.

A language has a reference only if at least ``MIN_DOCS`` different documents stand behind it, each of
which passes the base rule and is usual: its characters, with letters of all scripts and spaces as one class, are
not too far from the mean of all documents.  So a few texts under a rare language code found no reference and
can't widen what others may look like.  Documents of a language without a reference are kept if they are usual.

What is too far follows from the documents themselves: different texts that pass the base rule are
grouped by nearest language and length (powers of two; neighbouring lengths together until there are ``MIN_DOCS``), and a document may be as far as the group's
median and ``SPREAD`` times what lies between the lowest tenth and the median (junk
lies above the median and doesn't widen this); ``LEAST`` stands in for a narrower gap.
Longer documents have less noise, so a group's bound is no higher than those of shorter ones.
A language with fewer documents than that near to it takes the bounds of all languages together.

References come from all such documents of a language: exact sums by Spark.  Words below
one in ten thousand of a language are dropped before the ranking, which leaves at
most ten thousand a language whatever the size.

Cases: null and empty texts have no words and fail the base rule; a null language
is a language of its own; copies of a text count once for references' support and for bounds; a table without references
(too few documents, or none with a word) applies the base rule and what is usual; where fewer than ``MIN_DOCS`` are measured at all they
are one group; a text with none of a language's common words is at distance 1; rows are judged one by one, so repeated rows agree; a distance that is just the
bound is kept.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrec.llm.common import released, stage, text_or_empty

COMMON_WORDS = 60
MIN_SHARE = 1e-4
MIN_WORDS, MIN_CHARS = 50, 400
#: Different documents behind a reference, and behind a bound.
MIN_DOCS = 20
#: How far a document may be from its group's median, as a multiple of the gap below it, and that gap at least.
SPREAD, LEAST = 4.0, 0.03
#: Distances are counted in steps of one part in so many.
STEPS = 1000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 150_000

#: Letters are told apart as ASCII ones by case, further Latin ones, and those of other scripts.
CLASSES = ("lower", "upper", "accented", "letter", "mark", "digit", "point", "symbol", "space", "other")
_KINDS = {"L": "letter", "M": "mark", "N": "digit", "P": "point", "S": "symbol", "Z": "space"}


def _class_of(code: int) -> str:
    c = chr(code)
    if c.isspace() or c in SYMBOLS:
        return "space" if c.isspace() else "symbol"
    kind = _KINDS.get(unicodedata.category(c)[0], "other")
    if kind == "letter" and code < 0x250:
        return "accented" if code > 127 else "upper" if c.isupper() else "lower"
    return kind


@cache
def _class_table() -> np.ndarray:
    """The class of each code point."""
    return np.array([CLASSES.index(_class_of(code)) for code in range(0x110000)], np.uint8)


def char_classes(text: str) -> np.ndarray:
    """How many characters of each class the text has."""
    return np.bincount(_class_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=len(CLASSES))


#: Classes for what is usual in any language: text, and what isn't.
USUAL = np.array([0, 0, 0, 0, 0, 1, 2, 3, 0, 4])


def usual_shares(classes: np.ndarray) -> np.ndarray:
    """Shares of text, digits, points, symbols and others."""
    return np.bincount(USUAL, weights=classes, minlength=5) / max(1, classes.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = text.split("\n")
    again = len(lines) - len(set(lines))
    if again:
        again = sum(k - 1 for line, k in Counter(lines).items() if k > 1 and line.strip(SPACES))
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        upto = 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeated += i + WINDOW - max(i, upto)
                upto = i + WINDOW
    return n, chars, sum(map(text.count, SYMBOLS)), again, repeated


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histogram ``p`` from each row of ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _length_of(n: int) -> int:
    return max(1, n).bit_length() - 1


def _class_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for cell in batch["text"]:
            text = cell.as_py()
            if len(text) >= MIN_CHARS:
                out.append((_length_of(len(text)), usual_shares(char_classes(text)).tolist()))
            else:
                out.append((None, None))
        length, shares = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([batch["tie"], pa.array(length, pa.int32()), pa.array(shares, pa.list_(pa.float64()))], ["tie", "length", "shares"])


class Usual:
    """What characters documents of any language have, and how far from that is too far at each length."""

    def __init__(self, shares: list[float], bounds: dict[int, float]):
        self.shares, self.bounds = np.array(shares), bounds

    def distance(self, classes: np.ndarray) -> float:
        return float(distance(usual_shares(classes), self.shares))

    def fits(self, classes: np.ndarray, length: int) -> bool:
        """True for what is too short to tell."""
        return length < MIN_CHARS or self.distance(classes) <= self.bounds.get(_length_of(length), np.inf) + 0.5 / STEPS


def usual_of(rows: DataFrame, spread: float = SPREAD) -> Usual:
    """The mean shares of all different texts of ``rows (tie, text)``, and the bounds."""
    seen = stage(rows.select("tie", "text").mapInArrow(released(_class_tasks), "tie long, length int, shares array<double>").filter("length is not null").dropDuplicates(["tie"]), "usual-shares")
    mean = [x or 0.0 for x in seen.agg(*[F.avg(F.col("shares")[k]) for k in range(5)]).first()]
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    p, q = [F.col("shares")[k] for k in range(5)], [F.lit(x) for x in mean]
    far = F.sqrt(F.greatest(sum((term(a, (a + b) / 2) + term(b, (a + b) / 2) for a, b in zip(p, q, strict=True)), F.lit(0.0)) / 2, F.lit(0.0)))
    counts = seen.groupBy("length", F.round(far * STEPS).cast("int").alias("steps")).count().collect()  # lengths times steps
    return Usual(mean, {length: bound for _, length, bound in group_bounds([(None, *r) for r in counts], spread)})


def _count_tasks(usual: Usual):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}
        chars: dict[str | None, np.ndarray] = {}
        ties: dict[str | None, set] = {}
        held = 0

        def columns(langs: list, words: list, classes: list, ties: list, n: list) -> pa.RecordBatch:
            filled = [x if x is not None else [None] * len(n) for x in (langs, words, classes, ties)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(filled, kinds, strict=True)), pa.array(n, pa.int64())], ["lang", "word", "class", "tie", "n"])

        def rows() -> Iterator[pa.RecordBatch]:
            for lang in list(chars):
                found, counted, own = words.pop(lang), chars.pop(lang), ties.pop(lang)
                yield columns([lang] * len(CLASSES), None, list(CLASSES), None, [int(n) for n in counted])
                yield columns([lang] * len(own), None, None, list(own), [1] * len(own))
                yield columns([lang] * len(found), [w.decode() for w in found], None, None, list(found.values()))

        for batch in batches:
            for lang, tie, cell in zip(batch["lang"].to_pylist(), batch["tie"].to_pylist(), batch["text"], strict=True):
                text = cell.as_py()
                classes, found = char_classes(text), text.encode().split()
                if base_failed(base_counts(text, found)) or not usual.fits(classes, len(text)):
                    continue
                words.setdefault(lang, Counter()).update(text.lower().encode().split())
                chars[lang] = chars.get(lang, 0) + classes
                # so many different ones are enough to tell that there are enough
                if len(own := ties.setdefault(lang, set())) < MIN_DOCS:
                    own.add(tie)
                held += 1
                if held % 64 == 0 and sum(map(len, words.values())) > HELD_WORDS:
                    yield from rows()
        yield from rows()

    return run


def base_failed(counts: tuple) -> bool:
    """The base rule on ``base_counts``."""
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def references(rows: DataFrame, usual: Usual, common: int = COMMON_WORDS) -> list[dict]:
    """For each language with enough documents its common words with their shares, and its character classes' shares.

    ``rows (lang, tie, text)``.  What reaches the driver is ``common`` words and a few classes a language.
    """
    counted = rows.select(F.col("lang").cast("string"), "tie", "text").mapInArrow(released(_count_tasks(usual)), "lang string, word string, class string, tie long, n long")
    counts = stage(counted.groupBy("lang", "word", "class", "tie").agg(F.sum("n").alias("n")), "reference-counts")
    able = counts.filter("tie is not null").groupBy("lang").count().filter(F.col("count") >= MIN_DOCS).select("lang")
    counts = counts.join(able.withColumnRenamed("lang", "able"), F.col("lang").eqNullSafe(F.col("able")), "left_semi")
    classes, totals = {}, {}
    for r in counts.filter("class is not null").collect():
        classes.setdefault(r["lang"], {})[r["class"]] = r["n"]
    words = counts.filter("word is not null")
    for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        totals[r["lang"]] = r["n"]
    kept = [(lang, n) for lang, n in totals.items() if n]
    top: dict[str | None, list] = {}
    if kept:
        floor = words.sparkSession.createDataFrame(kept, "of string, total long")
        # at most 1 / MIN_SHARE words a language are left for the ranking
        frequent = words.join(F.broadcast(floor), F.col("lang").eqNullSafe(F.col("of"))).filter(F.col("n") >= F.col("total") * MIN_SHARE).select("lang", "word", "n", "total")
        ranked = frequent.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("k") <= common)
        for r in ranked.orderBy("lang", "k").collect():
            top.setdefault(r["lang"], []).append((r["word"], r["n"] / r["total"]))
    found = []
    for lang, listed in top.items():
        shape = np.array([classes[lang].get(c, 0) for c in CLASSES], float)
        shares = [s for _, s in listed]
        found.append({"lang": lang, "words": [w for w, _ in listed], "shares": [s / sum(shares) for s in shares], "classes": (shape / shape.sum()).tolist()})
    return found


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, word_distance double, char_distance double, nearest string, char_nearest string, own_reference boolean, usual boolean, tie long"


def _measure_tasks(found: list[dict], usual: Usual):
    own = {ref["lang"] for ref in found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[bytes, list[tuple[int, int]]] = {}
        for k, ref in enumerate(found):
            for i, word in enumerate(ref["words"]):
                bins.setdefault(word.encode(), []).append((k, i))
        shares = [np.array(ref["shares"]) for ref in found]
        shapes = np.array([ref["classes"] for ref in found])
        for batch in batches:
            out = []
            for doc_id, lang, tie, cell in zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist(), batch["tie"].to_pylist(), batch["text"], strict=True):
                text = cell.as_py()
                words, classes = text.encode().split(), char_classes(text)
                counts = base_counts(text, words)
                n = counts[0]
                far = shape = near = like = None
                if found and n >= MIN_WORDS:
                    seen = [np.zeros(len(s)) for s in shares]
                    for word, times in Counter(text.lower().encode().split()).items():
                        for k, i in bins.get(word, ()):
                            seen[k][i] += times
                    each = [float(distance(s / s.sum(), q)) if s.any() else 1.0 for s, q in zip(seen, shares, strict=True)]
                    far = min(each)
                    near = found[each.index(far)]["lang"]
                if found and len(text) >= MIN_CHARS:
                    each = distance(classes / len(text), shapes)
                    shape, like = float(each.min()), found[int(each.argmin())]["lang"]
                out.append((doc_id, *counts, base_failed(counts), far, shape, near, like, lang in own, usual.fits(classes, len(text)), tie))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in MEASURES.split(", ")])

    return run


def group_bounds(counts: list[tuple[str | None, int, int, int]], spread: float = SPREAD, least: float = LEAST, enough: int = MIN_DOCS) -> list[tuple[str | None, int, float]]:
    """``language, length, bound`` from ``language, length, steps, documents``."""
    groups: dict[str | None, dict[int, Counter]] = {}
    whole: dict[int, Counter] = {}
    for lang, length, steps, n in counts:
        groups.setdefault(lang, {}).setdefault(length, Counter())[steps] += n
        whole.setdefault(length, Counter())[steps] += n

    def bounds(lengths: dict[int, Counter]) -> dict[int, float]:
        """Short lengths go with the next ones until there are enough; what is left at the end goes with those before."""
        parts, mine, held = [], [], Counter()
        for length in sorted(lengths):
            mine.append(length)
            held += lengths[length]
            if held.total() >= enough:
                parts.append((mine, held))
                mine, held = [], Counter()
        if mine:
            before = parts.pop() if parts else ([], Counter())
            parts.append((before[0] + mine, before[1] + held))
        out, bound = {}, np.inf
        for mine, held in parts:
            values = sorted(held.items())
            upto = np.cumsum([n for _, n in values])
            low, median = (values[int(np.searchsorted(upto, share * upto[-1]))][0] / STEPS for share in (0.1, 0.5))
            bound = min(bound, median + spread * max(median - low, least))
            out |= dict.fromkeys(mine, bound)
        return out

    everywhere = bounds(whole)
    out = []
    for lang, lengths in groups.items():
        own = bounds(lengths) if sum(c.total() for c in lengths.values()) >= enough else everywhere
        out += [(lang, length, own[length]) for length in lengths]
    return out


def _too_far(rows: DataFrame, distance: str, near: str, size: str, spread: float) -> DataFrame:
    """``rows`` with a column ``<distance>_bound``; null where the distance is."""
    length = F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))).cast("int")
    measured = rows.filter(F.col(distance).isNotNull() & ~F.col("base_failed"))
    counts = measured.groupBy(near, length.alias("length"), F.round(F.col(distance) * STEPS).cast("int").alias("steps")).agg(F.countDistinct("tie")).collect()
    # a few rows for each language
    bounds = rows.sparkSession.createDataFrame(group_bounds([tuple(r) for r in counts], spread), f"_lang string, _length int, {distance}_bound double")
    joined = rows.withColumn("_at", length).join(F.broadcast(bounds), F.col(near).eqNullSafe(F.col("_lang")) & (F.col("_at") == F.col("_length")) & F.col(distance).isNotNull(), "left")
    return joined.drop("_at", "_lang", "_length")


def judge_quality(docs: DataFrame, *, spread: float = SPREAD) -> DataFrame:
    """The measures of every document, and ``kept``."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text_or_empty()).withColumn("tie", F.xxhash64("text"))
    usual = usual_of(texts, spread)
    found = references(texts, usual)
    rows = stage(texts.mapInArrow(released(_measure_tasks(found, usual)), MEASURES), "quality-measures")
    rows = _too_far(rows, "word_distance", "nearest", "n_words", spread)
    rows = _too_far(rows, "char_distance", "char_nearest", "word_chars", spread)
    strange = [F.coalesce(F.col(x) > F.col(f"{x}_bound") + 0.5 / STEPS, F.lit(False)) for x in ("word_distance", "char_distance")]
    fits = F.when(F.col("own_reference"), ~(strange[0] | strange[1])).otherwise(F.col("usual"))
    return rows.withColumn("kept", ~F.col("base_failed") & fits).drop("tie")
