"""The resampler, the chunked encoder and the alignment against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest

from tallyrec.llm import alignment, byte_bpe, queries, resampling

SF = "/root/testdata/sf0.001"
RANKS = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
A_PATH, B_PATH = queries.tokenizer_path(), str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [
    None, "", " ", "a", "  two  spaces ", "don't we'll 'sx ''s", "tab\there\n\nand\r\nthere \n x", "zahl 12345 x9", "<|endoftext|> is text, <s> too </s>", "ﬁ Ａé é", "mark ▁ here",
    "нет да привет мир", "日本語 のテキスト", "emoji 😀😀 x", "nbsp\xa0\xa0here \x1c \x85 y", "x" * 3000, "a b " * 900, " " * 700 + "end", "été\n" * 300, "\x00 nul", "UPPER lower MiXeD", "one_two-three.four",
]


def odd_docs(spark, texts=None):
    rows = [(i, t, "extra", i * 2) for i, t in enumerate(ODD if texts is None else texts)]
    rows += [(None, "no id here", "x", 0), (3, "a", "x", 0), (3, "a", "x", 0), (5, "same id, other text", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string, key long")


def plain_runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target):
    totals = []
    for texts in ([t for _, t in docs], target):
        totals.append(Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in plain_runs(t)[1]))
    s, t = totals
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for doc_id, text in docs:
        words, runs = plain_runs(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in (zlib.crc32(f.encode()) % 10000 for f in runs))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: len(able) * 5 // 100])}
    return sorted([(*r[:4], ranks.get(id(r))) for r in out], key=str)


@pytest.mark.parametrize("head", [(65_535, 131_072), (50, 20), (0, 0)])
def test_resampling_equals_plain(spark, head):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    target = queries.table(spark, SF, "benchmark")
    got = resampling.resample(docs, target, head_words=head[0], head_pairs=head[1]).collect()
    want = plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert sorted([tuple(r) for r in got], key=str) == want


def test_blocks_carry_words_over(monkeypatch):
    monkeypatch.setattr(resampling, "STRETCH", 50)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.choice([1, 2, 3, 90]))) for _ in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 500]))) for _ in range(60)]
    head = resampling.Head([w.encode() for w in vocabulary[:10] if len(w) < 20], [(vocabulary[0].encode(), vocabulary[1].encode())])
    for size in (1, 3, 7, 1000):
        got = defaultdict(Counter)
        for words, doc, old in resampling.word_blocks([t.encode() for t in texts], size):
            for b, d in zip(*(x.tolist() for x in head.features(words, doc, old)), strict=True):
                got[d][b] += 1
        for i, t in enumerate(texts):
            assert got[i] == Counter(zlib.crc32(f.encode()) % 10000 for f in plain_runs(t)[1])


def test_head_is_found_and_used(spark):
    rows = resampling._rows(queries.table(spark, SF, "documents"))
    head = resampling.learn_head(rows, 500, 20_000)
    assert 20 < len(head.words) <= 500 and 20 < len(head.pairs) <= 20_000
    assert (head.tables[3] != 0xFFFFFFFF).sum() >= 0.9 * len(head.pairs)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert [r["rank"] for r in resampling.resample(some, none).collect()] == [None]


def test_resampling_equals_sql(spark):
    sql = queries.ORACLE_SQL["op11_importance_resampling"]
    assert oracle.differences(queries.op11_importance_resampling(spark, SF), sql, oracle.connect(SF)) == ""


def plain_bpe(text):
    own = byte_bpe.codec(RANKS, public_tokenizers.PATTERN).library
    ids = own.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("cut", [(1 << 15, 256), (300, 40), (40, 12)])
def test_encoding_equals_library(spark, cut):
    docs = odd_docs(spark)
    got = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, chunk=cut[0], overlap=cut[1]).collect()
    want = [(r["doc_id"], *plain_bpe(r["text"])) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encoding_of_the_table(spark):
    got = byte_bpe.round_trip(queries.table(spark, SF, "documents"), RANKS, public_tokenizers.PATTERN, chunk=500, overlap=64).collect()
    want = [(r["doc_id"], *plain_bpe(r["text"])) for r in queries.table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_random_strings_in_chunks(spark):
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "1", " ", "  ", "\n", "'", "s", "'ll", "-", "\t", "\xa0", "я", "語", "😀", "　"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, chunk=30, overlap=10).collect()
    assert sorted(map(tuple, got)) == [(i, *plain_bpe(t)) for i, t in enumerate(texts)]


def test_encoding_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).collect() == []


def plain_alignment(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    own = alignment.aligner((A_PATH, B_PATH))
    alphabet = {c: b for b, c in own.a.known.alphabet.items()}
    found, seen = [], Counter()
    for _, text in docs:
        whole = " " + (text or "")
        a, b = a_model.encode(whole, add_special_tokens=False).ids, b_model.encode(text or "")
        a_bytes = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        if not text or b"".join(a_bytes) != whole.encode() or b"".join(b_bytes) != whole.encode():
            found.append(None)
            continue
        a_ends, b_ends = np.cumsum([*map(len, a_bytes)]).tolist(), np.cumsum([*map(len, b_bytes)]).tolist()
        both = set(a_ends) & set(b_ends)
        groups, i, j = [], 0, 0
        for end in sorted(both):
            m, n = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        links, j = [], 0
        for i, end in enumerate(a_ends):
            start = a_ends[i - 1] if i else 0
            while True:
                links.append((a[i], b[j]))
                if b_ends[j] >= end:
                    j += b_ends[j] == end
                    break
                j += 1
            assert start < end
        seen.update(set(links))
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (a, _), n in seen.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, _), f in zip(docs, found, strict=True):
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(seen[x] == best[x[0]] for x in links), sum(seen[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("head", [alignment.HEAD, 500, 0])
def test_alignment_equals_plain(spark, head):
    docs = odd_docs(spark).select("doc_id", "text").unionByName(queries.table(spark, SF, "documents").select("doc_id", "text"))
    got = alignment.alignment_counts(docs, A_PATH, B_PATH, head=head).collect()
    assert sorted(map(tuple, got), key=str) == plain_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_alignment_in_pieces(monkeypatch):
    """Cut texts give what whole ones give."""
    own = alignment.aligner((A_PATH, B_PATH))
    rng = random.Random(3)
    words = ["the", "Wörter", "x1", "12", "a\nb", "don't", "日本", "—", "naïve,", "  gap"]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(20)] + ["bad ▁ " + "word " * 300]
    seen = []
    for piece, block in ((alignment.PIECE, alignment.BLOCK), (64, 100)):
        monkeypatch.setattr(alignment, "BLOCK", block)
        monkeypatch.setattr(alignment.pieces_of, "__defaults__", (piece,))
        batch = alignment._Batch(own, len(texts))
        for i, t in enumerate(texts):
            batch.add(i, t)
        seen.append(batch.rows(alignment.pa.array(range(len(texts)))).to_pylist())
    assert seen[0] == seen[1] and seen[0][-1]["n_a"] == 0 and seen[0][0]["n_a"] > 400


def test_cuts_are_the_common_ends():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, 40)), n)) for _ in range(2))
        m = int(rng.integers(1, 30))
        c, d = (np.unique(np.append(rng.integers(1, m + 1, rng.integers(1, 20)), m)) + n for _ in range(2))
        ends, others = np.concatenate([a, c]), np.concatenate([b, d])
        cut = alignment.shared_cuts(ends, others, np.array([len(a) - 1, len(ends) - 1]))
        assert (cut == np.isin(ends, others)).all()


def test_alignment_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_counts(none, A_PATH, B_PATH).collect() == []
