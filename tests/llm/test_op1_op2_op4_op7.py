import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrec.llm import components, queries, simhash, token_store, url_filter, warc_store

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_tokens long, fp string, part int"
ODD = [(3, "b c d e f", 1, "x", 1), (None, "no id", 1, "x", 1), (1, None, 1, "x", 1), (2, "", None, None, None), (3, "a", 1, "x", 1), (3, "a", 1, "x", 1), (9, "wörd " * 30000, 1, "x", 1), (10, "one two\r\n\x85 three  \n\n four\xa0five\x1c <|endoftext|>", 1, "x", 1)]


def tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    return path, Tokenizer.from_file(path)


def expected_tokens(rows, found):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for d, t in rows:
        ids = found.encode(t, add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_tokens_equal_a_plain_encoding(spark):
    path, found = tokenizer()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in queries.op1_token_offsets(spark, SF).collect()]
    assert sorted(got) == expected_tokens([tuple(r) for r in docs.select("doc_id", "text").collect()], found)


def test_tokens_of_odd_rows(spark):
    path, found = tokenizer()
    rows = spark.createDataFrame(ODD, DOCS)
    got = [tuple(r) for r in token_store.token_offsets(rows, path, segment_ids=7).collect()]
    want = expected_tokens([r[:2] for r in ODD], found)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(got, key=key)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((r[2], r[3]) for r in got) == sorted((r[2], r[3]) for r in want)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    assert token_store.token_offsets(rows.limit(0), path).count() == 0


def test_units_equal_the_library_on_random_texts():
    path, found = tokenizer()
    encode, width = token_store.encoder(path)
    rng = np.random.default_rng(1)
    alphabet = [*map(chr, range(0x250)), *"  \n\n\t'", *"aeiost", "'s", "'ll", " 12", "<|endoftext|>", "\u2028", "\u4e2d"]
    for _ in range(3000):
        text = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(0, 40)))
        assert np.frombuffer(encode(text), f"<u{width}").tolist() == found.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("lengths", [[1], [5, 1, 1, 900, 2], [3] * 500, [1, 100000, 1]])
def test_elias_fano_round_trip(lengths):
    ids = np.arange(sum(lengths)).astype("<u2").tobytes()
    segment = token_store.Segment(token_store.pack(list(range(len(lengths))), lengths, ids, 2))
    ends = np.cumsum(lengths)
    assert segment.ends().tolist() == ends.tolist()
    assert [segment.select(i) for i in range(len(lengths))] == ends.tolist()
    assert len(segment.document(len(lengths) - 1)) == lengths[-1]
    assert len(segment.high) + len(segment.lows) <= len(lengths) * (3 + max(0, int(np.log2(max(1, ends[-1] / len(lengths))))) ) / 8 + 2


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * 40, "r") for i in range(60)] + [(100, None, big, "r"), (101, "u\r\n v", big, "r"), (102, "é", big, "r"), (102, "é", big, "r"), (None, "n", big, "r"), (200, "k", None, "r"), (201, "k", "short", "r"), (202, "k", "short", "r"), (None, "z", "y" * 2000, "r"), (None, "z", "y" * 2000, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2)
    folder = f"file://{tmp_path}/w"
    warc_store.write_archives(pages, folder, archive_bytes=4000)
    got = warc_store.read_archives(spark, folder).collect()
    assert len(got) == len(rows)
    revisits = sorted((r.page_id is not None, r.page_id or 0) for r in got if r.record_type == "revisit")
    assert revisits == [(False, 0), (True, 100), (True, 101)]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {102}
    assert all(r.payload_bytes == 1500 for r in got if r.record_type == "revisit")
    want = sorted((r[2] or "").encode() for r in rows)
    shown = sorted([bytes(r.payload) for r in got if r.payload is not None] + [big.encode()] * 3)
    assert shown == want
    assert sorted((r.url or "-") for r in got) == sorted((r[1] or "-") for r in rows)
    assert warc_store.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [[(1, "u", "")], [(1, "u", "<p>x</p>" * 9), (2, None, None)], [(i, f"http://h/{i} %41", f"<html>{i}</html>" * i) for i in range(300)], [(1, "u", "".join(map(str, range(60_000))))]])
def test_any_record_is_read_from_its_offset_with_plain_zstandard(spark, tmp_path, rows):
    import zstandard

    warc_store.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    seen = {}
    for path in (tmp_path / "w" / "data").glob("*.warc.zst"):
        raw = path.read_bytes()
        assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
        at = 8 + int.from_bytes(raw[4:8], "little")
        words, offsets = zstandard.ZstdCompressionDict(raw[8:at]), []
        while at < len(raw):
            offsets.append(at)
            one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            one.decompress(raw[at:])
            at = len(raw) - len(one.unused_data)
        for at in reversed(offsets):
            fields = warc_store.parse(zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(raw[at:]))
            seen[int(fields["X-Page-ID"])] = fields["payload"].decode()
    assert seen == {i: html or "" for i, _, html in rows}


def test_warc_dictionary_frame_leads(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    warc_store.write_archives(pages, f"file://{tmp_path}/w")
    heads = {p.read_bytes()[:4] for p in (tmp_path / "w" / "data").glob("*.warc.zst")}
    assert (0x184D2A5D).to_bytes(4, "little") in heads


def brute_components(codes, budget=4):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(codes, 2):
        if (a ^ b).bit_count() <= budget:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [50_000, 3])
def test_simhash_groups_equal_brute_force(spark, hot):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    edited = base.filter("doc_id % 5 = 0").select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat(F.lit("more "), "text").alias("text"))
    docs = base.union(edited).union(spark.createDataFrame([(r[0], r[1]) for r in ODD], "doc_id long, text string"))
    rows = docs.collect()
    want = {}
    roots = brute_components(sorted({plain_fingerprint(r.text) for r in rows}))
    names = {}
    for r in rows:
        root = roots[plain_fingerprint(r.text)]
        if r.doc_id is not None:
            names[root] = min(names.get(root, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{plain_fingerprint(r.text):016x}", names.get(roots[plain_fingerprint(r.text)])) for r in rows), key=str)
    got = simhash.near_groups(docs, hot=hot).select("doc_id", simhash.hex_of(), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len(names) < len({r[1] for r in want})


@pytest.mark.parametrize("fixed", [0, 13])
def test_trie_groups_of_crowds(fixed):
    rng = np.random.default_rng(3)
    core = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = [core[rng.integers(6)] ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 51, rng.integers(0, 5)))) for _ in range(400)]
    codes = np.unique(np.array(flips, np.uint64))
    got = simhash.trie_groups(codes, fixed, chunk=64)
    roots = brute_components(codes.tolist())
    assert [int(codes[g]) for g in got] == [roots[c] for c in codes.tolist()]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (7, 7), (None, 4), (300, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {200: 100, 300: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_rules_of_odd_urls(spark):
    rules = spark.createDataFrame(queries.URL_RULES, url_filter.RULES)
    urls = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/en/12?x#y"), (4, "http://example.org"), (5, "x://y.com/de/"), (6, "http://xexample.org/es/"), (7, "://"), (8, "http://a.com/fr/?/de/"), (8, "http://a.com/fr/?/de/"), (None, "http://example.org/es/q")]
    pages = spark.createDataFrame([(a, b, "h", "v") for a, b in urls], "page_id long, url string, host string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "/en/12", "example.org/en/1", "block"), (4, "example.org", "", None, "allow"), (5, "y.com", "/de/", "com/de/", "block"), (6, "xexample.org", "/es/", "org/", "allow"), (7, "", "", None, "allow"), (8, "a.com", "/fr/", "com/fr/", "allow"), (None, "example.org", "/es/q", "example.org/es/", "block")}
    assert url_filter.judge_urls(pages, rules).count() == len(urls)
    assert url_filter.judge_urls(pages, rules.limit(0)).filter("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
