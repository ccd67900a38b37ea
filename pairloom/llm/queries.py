"""Registered queries of the corpus operators, with production parameters, and their check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.llm import (
    decontaminate, fuzzy_lines, languages, lexical_search, licenses, mixing, near_dups, neighbours, pitman_yor, sharding,
    token_alignment, token_counts, url_filter)
from pairloom.llm.tables import read

SHARDS = 40
#: Share of the corpus's tokens that a mixture takes, and how often a leaf may be read.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 60, 2, 11
#: Weights by level; what is not named has weight 1.
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
DOMAIN_WEIGHTS = {"d0": 3, "d1": 2}
#: Host and path rules of the url filter; the longest that fits decides.
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")
#: Every so many vectors one is a query, and how many neighbours it gets.
QUERY_EVERY, NEIGHBOURS = 20, 20
TOKENIZER, TOKEN_LIMIT = "byte_bpe_50k.json", 1024
#: The tokenizer aligned with TOKENIZER, and how many documents an item gets.
OTHER_TOKENIZER, RANKED = "piece_bpe_32k.model", 50


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus 16 for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def source_domain(source: Column) -> Column:
    """The tables name no domain: one of four, from the number at the end of the source's name."""
    return F.concat(F.lit("d"), F.pmod(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(4)).cast("string"))


def mix_weights() -> list[Column]:
    """Weight columns of domain, language and source."""
    of = lambda c, table: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in table.items()], F.lit(1))
    return [of("domain", DOMAIN_WEIGHTS), of("lang", LANG_WEIGHTS), F.when(F.col("source") == "src0", 2).otherwise(1)]


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    keys = docs.select("doc_id", text_bytes(F.col("text")).alias("size"),
                       F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("_text"))
    return sharding.shard(keys, SHARDS, F.col("size"), text="_text").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    total = F.expr(f"(corpus * {MIX_SHARE}) div 100")
    return mixing.mix(docs, source_domain(F.col("source")), total, mix_weights(), MIX_EPOCHS, MIX_SEED).drop("text_key")


def op3_hash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS)


#: Words of hosts in the small labelled table of the url filter (fixed values): junk and ordinary.
JUNK_HOSTS = (
    "casino poker bets betting jackpot slots roulette lottery pills viagra pharma-cheap cheap adult xxx porn sex "
    "webcam-girls escort spam spam-mail ads adserver track tracker clicks popup free-money win-big winner payday "
    "loans replica warez torrent crack keygen phishing malware farm-links link-farm").split()
PLAIN_HOSTS = (
    "news weather library museum school garden history science recipes travel health music sport city river mountain "
    "language grammar dictionary archive market journal review forum wiki docs data maps art film theatre physics "
    "chemistry biology math nature climate energy transport rail bridge harbour village church bread cheese winter "
    "summer letters poems novel story radio press council court police hospital clinic nursing teacher student then "
    "there other nation station mention earth thing strong ring hand land end ten tin red bed").split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table: url, label (1: junk). Languages, sections and domains are dealt alike."""
    rows = []
    for label, hosts in ((1, JUNK_HOSTS), (0, PLAIN_HOSTS)):
        for i, host in enumerate(hosts):
            for j, (front, end) in enumerate((("", "com"), ("www.", "net"), ("blog.", "org"), ("m.", "net"))):
                other = hosts[(i + 7 * j + 1) % len(hosts)]
                name = host if j % 2 else f"{host}-{other}"
                lang = ("en", "de", "fr", "es")[(i + j) % 4]
                rows.append((f"https://{front}{name}.example.{end}/{lang}/{(i * 37 + j * 11) % 997}{('', '.html', '/', '')[j]}", label))
    return spark.createDataFrame(rows, "url string, label int")


def op4_url_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.rule(x) for x in URL_RULES]
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, rules, url_filter.train(labelled_urls(spark)), "url")
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"),
                         F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op5_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read(spark, sf_dir, "documents")).drop("text_key")


def op7_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(read(spark, sf_dir, "documents"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(read(spark, sf_dir, "documents"))


def op9_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)


def op10_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(read(spark, sf_dir, "documents"))


def op11_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), RANKED)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                                 public_tokenizers.path(OTHER_TOKENIZER))


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_histogram_shards, op2_source_mixture, op3_hash_neighbours, op4_url_regression, op5_benchmark_windows,
    op6_near_duplicates, op7_license_compression, op8_fuzzy_lines, op9_pretoken_counts, op10_language_codes,
    op11_shared_search, op12_token_alignment, op13_pitman_yor)}

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op11_shared_search": f"""
        with d as materialized (select row_number() over () r, doc_id, {_TERMS} l from documents),
        sizes as (select r, doc_id, len(l) n from d where len(l) > 0),
        corpus as (select count(*) n_docs, cast(sum(n) as bigint) len from sizes),
        asked as (select distinct item_id, unnest({_TERMS}) term from benchmark),
        held as materialized (select r, term, count(*) tf from (select r, unnest(l) term from d)
            where term in (select term from asked) group by r, term),
        weights as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) w
            from (select term, count(*) df from held group by term), corpus),
        scored as (select item_id, s.r, doc_id,
                cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // len)))) as bigint) score
            from asked join held using (term) join weights using (term) join sizes s on s.r = held.r, corpus
            group by item_id, s.r, doc_id),
        ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank,
                doc_id, score from scored where score > 0)
        select item_id, rank, doc_id, score from ranked where rank <= {RANKED}""",
}
