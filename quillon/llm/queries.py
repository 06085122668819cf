"""The queries opN_<name> of the corpus operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_layout, language, mixing, neardup, packing, quality, sharding, spotsigs, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return keep


@query(
    "op10_quality_cascade",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
      SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d),
    g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
          FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2),
    c AS (SELECT doc_id, sum(covers) AS n FROM (
            SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS covers FROM r)
          GROUP BY doc_id),
    m AS (
      SELECT w.doc_id, w.t, w.words, CAST(len(w.words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(w.lines) - len(list_distinct(w.lines)) AS BIGINT) AS n_dup_lines, len(w.lines) AS n_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR n_symbols > 0.10 * length(t) OR word_chars < 2 * n_words OR word_chars > 25 * n_words
                OR 2 * n_dup_lines > n_lines OR len(regexp_extract_all(t, '!{2,}')) > 0.25 * n_words
                OR 5 * len(list_filter(words, lambda x: x = '|')) > n_words
                OR 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars
                OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > word_chars) AS kept
    FROM b
    """,
)
def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = quality.P
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        *[F.col(p + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        F.col(p + "kept").alias("kept"),
    )


@query("op6_minhash_components")
def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


@query("op3_sampled_splitters")
def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text has the CRC-32 of no bytes, 0."""
    dealt = sharding.shard_texts(read(spark, sf_dir, "documents"))
    return dealt.select(
        F.col("id").alias("doc_id"),
        "size",
        F.coalesce("text_crc32", F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

#: The rules of the query, and a block list of canonical URLs; a rule outranks the list.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
URL_BLOCK_LIST = [("cheap-pills.example.com", "/"), ("free-bets.example.com", "/"), ("spam-farm.example.org", "/")]


@query(
    "op5_bloom_url_filter",
    r"""
    WITH rules(h, p, v, rank) AS (VALUES ('org', '/', 'allow', 2), ('example.org', '/es/', 'block', 2),
      ('example.org', '/en/1', 'block', 2), ('com', '/fr/', 'allow', 2), ('com', '/de/', 'block', 2),
      ('cheap-pills.example.com', '/', 'block', 1), ('free-bets.example.com', '/', 'block', 1),
      ('spam-farm.example.org', '/', 'block', 1)),
    u AS (SELECT page_id, row_number() OVER () AS r,
                 coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')), '') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
    f AS (SELECT u.r, max(struct_pack(rank := rank, n := length(h || p), rule := h || p, v := v)) AS m
          FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.r)
    SELECT page_id, host, path, CASE WHEN f.m.rank = 2 THEN f.m.rule END AS rule, coalesce(f.m.v, 'allow') AS verdict
    FROM u LEFT JOIN f USING (r)
    """,
)
def op5_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [(h, p, v, 2) for h, p, v in URL_RULES] + [(h, p, "block", 1) for h, p in URL_BLOCK_LIST]
    listed = spark.createDataFrame(listed, "host string, path string, verdict string, rank int")
    judged = urls.judge(read(spark, sf_dir, "pages"), "page_id", "url", listed)
    return judged.select(
        F.col("id").alias("page_id"), "host", "path", F.when(F.col("rank") == 2, F.col("entry")).alias("rule"), "verdict"
    )


@query("op2_byte_cnn_language")
def op2_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return found.select(
        "doc_id",
        language.held_out("doc_id").alias("held_out"),
        F.col(language.P + "lang").alias("lang_pred"),
        F.col(language.P + "score").alias("score"),
    )


@query("op4_minimum_bin_slack")
def op4_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digests(packing.pack_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op9_hypergeometric_mix")
def op9_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.P
    dealt = mixing.deal(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return dealt.select(
        "doc_id",
        *[F.col(p + c).alias(c) for c in ("size", "source_size", "target")],
        (F.col(p + "size") * F.size(p + "copies")).alias("taken"),
        F.transform(p + "copies", lambda c: c.shard).alias("shards"),
    )


@query("op7_spot_signatures")
def op7_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.edited_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    sigs, edited, after = F.col("sigs"), F.col("edited_sigs"), F.col("next_sigs")
    return found.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(sigs).alias("fingerprint"),
        spotsigs.fingerprint(edited).alias("edited_fingerprint"),
        spotsigs.likeness(sigs, edited).alias("near_edited"),
        spotsigs.likeness(sigs, after).alias("near_next"),
    )


@query(
    "op8_zip_warc",
    """
    WITH h AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
    g AS (SELECT x, max(page_id) AS top FROM h GROUP BY x)
    SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
             (CAST(('0x' || substr(h.x, CAST(1 + 5 * (i // 4) AS BIGINT), 5)) AS BIGINT) // CAST(power(32, 3 - i % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> top THEN top END AS refers_to
    FROM h JOIN g ON h.x = g.x
    """,
)
def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    payload = F.coalesce(F.encode("html", "UTF-8"), F.to_binary(F.lit(""), F.lit("hex")))
    found = warc.read_packages(spark, *warc.write_packages(pages, "page_id", payload, F.col("url")), pages.schema["page_id"].dataType.simpleString())
    return found.select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


@query("op1_layout_text")
def op1_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_layout.extract(read(spark, sf_dir, "pages").select("page_id", "html"), "html", "text")
    return pages.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))
