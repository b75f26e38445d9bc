"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrec.llm import alignment, byte_bpe, decontaminate, packing, passages, quality_model, quality_rules, resampling, simhash, token_store, toxicity, url_filter, warc_store

END_ID = 2
#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_offsets(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.archive_pages(table(spark, sf_dir, "pages"))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_runs(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_overlapping_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op13_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment_counts(table(spark, sf_dir, "documents"), tokenizer_path(), str(public_tokenizers.path("piece_bpe_32k.model")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_offsets, op2_warc_dictionary, op3_quality_divergence, op4_simhash_trie, op5_quality_discriminant, op6_paragraph_minhash, op7_url_rules, op8_conflict_packing, op9_latent_decontamination, op10_toxicity_kernel, op11_importance_resampling, op12_overlapping_bpe, op13_shared_cuts)}


_URL_PARTS = r"""
    select page_id,
           case when instr(url, '://') > 0 then regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 1) else '' end as raw_host,
           case when instr(url, '://') > 0 then regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) else '' end as path
    from pages"""

ORACLE_SQL = {
    "op2_warc_dictionary": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
        w as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) else page_id end as last from d)
        select page_id, payload_bytes, payload_digest,
               case when last > page_id then 'revisit' else 'response' end as record_type,
               case when last > page_id then last end as refers_to
        from w""",
    "op7_url_rules": f"""
        with r(host, path, verdict) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
        u as ({_URL_PARTS}),
        n as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
        m as (
            select n.page_id, n.host, n.path, r.host || r.path as rule, r.verdict,
                   row_number() over (partition by n.page_id order by length(r.host || r.path) desc, length(r.host) desc, r.verdict desc) as k
            from n left join r on (n.host = r.host or ends_with(n.host, '.' || r.host)) and starts_with(n.path, r.path)
        )
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1""",
    # the sixteen numbers are fixed values: the CRC-32 of four bits by its polynomial
    "op11_importance_resampling": r"""
        with texts as (select 0 as side, doc_id as id, text from documents union all select 1, row_number() over (), text from benchmark),
        w as (select side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as words from texts),
        runs as (
            select side, id, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i : i + n - 1], ' '))) as run
            from w, (values (1), (2), (3)) as size(n) where len(words) >= n),
        kinds as (select run, hex(encode(run)) as digits from (select distinct run from runs)),
        sums as (
            -- CRC-32, four bits at a time: the low half of a byte first
            select run, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(digits)), lambda i: instr('0123456789ABCDEF', substr(digits, i + 1 + 1 - 2 * (i % 2), 1)) - 1)),
                lambda c, d: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][xor(c & 15, d) + 1]))) % 10000 as bucket
            from kinds),
        placed as (select side, id, bucket, count(*) as n from runs join sums using (run) group by all),
        totals as (select bucket, sum(n) filter (side = 0) as s, sum(n) filter (side = 1) as t from placed group by bucket),
        whole as (select coalesce(sum(s), 0) + 10000 as s_all, coalesce(sum(t), 0) + 10000 as t_all from totals),
        gains as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * s_all) / ((coalesce(s, 0) + 1)::double * t_all)))::bigint as gain from totals, whole),
        weights as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from placed join gains using (bucket) where side = 0 group by id),
        scored as (
            select d.id as doc_id, len(d.words) >= 20 as able, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
            from w d left join weights on weights.id = d.id where d.side = 0),
        places as (select *, row_number() over (partition by able order by score desc, doc_id) as place, count(*) over (partition by able) as n_able from scored)
        select doc_id, n_features, weight, score, case when able and place <= 5 * n_able // 100 then place end as rank from places""",
}
