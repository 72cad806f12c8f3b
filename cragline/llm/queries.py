"""The queries of the corpus operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.llm import alignment, ann, chunks, divergence, mixing, pieces, quality_model, quality_rules, shards, simhash, substring, token_files, url_lists


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.without_repeats(_table(spark, sf_dir, "documents"), width=13, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), with_ids=False)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, _tokenizer("byte_bpe_50k.json"), added=True)
    return token_files.read_digests(spark, folder)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.searched(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.sharded(_table(spark, sf_dir, "documents"), weights=[1.0] * 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def dated_hosts(pages: DataFrame) -> DataFrame:
    """A list history for the hosts of ``pages``, as the tables hold none: (list, domain, at, action) from each host's MD5.

    About a quarter of the hosts are added once in the year 2024 and removed some days later, half of these are added again;
    about an eighth are on a second list from some day on.
    """
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    digits = lambda at, n: F.conv(F.substring(F.md5("domain"), at, n), 16, 10).cast("int")
    hosts = hosts.select("domain", digits(1, 2).alias("a"), (digits(3, 3) % 300).alias("d"), (1 + digits(6, 2) % 60).alias("n"), digits(8, 1).alias("b"), digits(9, 2).alias("c"))
    day = lambda text: F.expr(f"timestamp'2024-01-01 00:00:00' + make_dt_interval({text})")
    row = lambda name, at, action, when: F.when(F.expr(when), F.struct(F.lit(name).alias("list"), at.alias("at"), F.lit(action).alias("action")))
    rows = F.array(row("spam", day("d"), "add", "a % 4 = 0"), row("spam", day("d + n"), "remove", "a % 4 = 0"), row("spam", day("d + 2 * n"), "add", "a % 4 = 0 AND b % 2 = 0"),
                   row("legal", day("c"), "add", "a % 8 = 1"))
    return hosts.select("domain", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select("e.list", "domain", "e.at", "e.action")


def op9_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages hold no fetch time; each gets one in 2024 from its id."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(pmod(page_id * 7919, 527040) AS INT))"))
    return url_lists.evaluated(captures, dated_hosts(pages), "url", "fetched", "page_id")


OP9_SQL = r"""WITH hosts AS (SELECT page_id, regexp_replace(lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '')), '\.$', '') AS host,
 TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919) % 527040) AS f FROM pages),
marks AS (SELECT domain, CAST('0x' || substr(m, 1, 2) AS INT) AS a, CAST('0x' || substr(m, 3, 3) AS INT) % 300 AS d, 1 + CAST('0x' || substr(m, 6, 2) AS INT) % 60 AS n,
 CAST('0x' || substr(m, 8, 1) AS INT) AS b, CAST('0x' || substr(m, 9, 2) AS INT) AS c FROM (SELECT DISTINCT host AS domain, md5(host) AS m FROM hosts WHERE host <> '')),
history AS (SELECT 'spam' AS list, domain, d AS day, 'add' AS action FROM marks WHERE a % 4 = 0 UNION ALL SELECT 'spam', domain, d + n, 'remove' FROM marks WHERE a % 4 = 0
 UNION ALL SELECT 'spam', domain, d + 2 * n, 'add' FROM marks WHERE a % 4 = 0 AND b % 2 = 0 UNION ALL SELECT 'legal', domain, c, 'add' FROM marks WHERE a % 8 = 1),
dated AS (SELECT list, domain, TIMESTAMP '2024-01-01' + to_days(day) AS since, action FROM history),
active AS (SELECT page_id, h.list, h.domain, max(h.since) AS since, max_by(h.action, h.since) AS action FROM hosts, dated h
 WHERE (host = h.domain OR ends_with(host, '.' || h.domain)) AND h.since <= f GROUP BY page_id, h.list, h.domain),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC, list, since) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM active WHERE action = 'add')
SELECT page_id, host, CAST(coalesce(n, 0) AS BIGINT) AS n_active, list, domain AS entry, since AS valid_from, n IS NULL AS allowed FROM hosts LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (page_id)"""


def op10_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(_table(spark, sf_dir, "documents"))


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exact_copies(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash_groups, op2_one_bit_codes, op3_substring_dedup, op4_quality_model, op5_sentencepiece, op6_token_files, op7_rendezvous_shards,
             op8_quality_rules, op9_dated_url_lists, op10_mixed_sources, op11_token_alignment, op12_source_divergence, op13_chunk_recipes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": quality_rules.duck_sql(), "op9_dated_url_lists": OP9_SQL, "op10_mixed_sources": mixing.duck_sql(), "op12_source_divergence": divergence.DUCK_SQL,
            "op13_chunk_recipes": chunks.DUCK_SQL}
