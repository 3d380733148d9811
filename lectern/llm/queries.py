"""Registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import decontamination, fingerprints, infill, linededup, ngramjoin, packing, pseudonyms, quality, repair, secrets, sharding, spelling, vptrees
from lectern.llm.shared import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    """Vocabulary files come with the box and are found by their package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document read back from grammar-compressed shards."""
    shards = repair.write_shards(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), added_tokens=True)
    return repair.with_starts(repair.read_documents(shards), shards).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their sequence and offset."""
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), added_tokens=True)


@query
def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = decontamination.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("item_ids")


#: Key of the registered query; a user passes a secret of their own.
DEMO_KEY = b"replace this key"


@query
def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal numbers, dates and addresses replaced."""
    return pseudonyms.pseudonymise_documents(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)


@query
def op6_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query
def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the written, shuffled shards."""
    rows = sharding.write_shards(documents(spark, sf_dir))
    return rows.select(
        "doc_id", sharding.sizes().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


ORACLES["op5_linked_secrets"] = secrets.oracle_sql()


@query
def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its successor."""
    return fingerprints.match_documents(documents(spark, sf_dir))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are similar to an earlier line."""
    return linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op2_ngram_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return ngramjoin.near_duplicates(documents(spark, sf_dir))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two units and rearranged, as digests."""
    return infill.digest(infill.fill_in_middle(documents(spark, sf_dir)))


ORACLES["op11_fill_in_middle"] = infill.oracle_sql()


@query
def op12_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return vptrees.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLES["op12_vantage_point_search"] = vptrees.oracle_sql()


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its more frequent spelling."""
    return spelling.spelling_variants(documents(spark, sf_dir))
