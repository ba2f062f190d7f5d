"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import alignment, exact_dedup, fingerprints, hard_negatives, html_extract, minhash, mixing, packing, quality, revisits, token_rollup, toxicity, urlfilter
from orrery.staging import Stages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(_table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.as_contract(exact_dedup.decide(_table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.as_contract(minhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


#: The rules of the registered query; each a verdict, a host and the start of a path.
URL_RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urlfilter.train(urlfilter.labelled_urls())
    return urlfilter.judge(_table(spark, sf_dir, "pages"), model, urlfilter.parse_rules(URL_RULES))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.as_rows(revisits.resolve(revisits.records_of(_table(spark, sf_dir, "pages"))))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    stages = Stages(spark, "rollup")
    slim = stages.save(token_rollup.tokenized(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "counts")
    return token_rollup.roll_up_tokenized(token_rollup.RollupStore(spark, f"{stages.root}/store"), slim, "byte_bpe_50k")


def op4_token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store under two versions that SQL can count."""
    stages = Stages(spark, "rollup")
    slim = stages.save(token_rollup.measured(_table(spark, sf_dir, "documents")), "counts")
    return token_rollup.roll_up(token_rollup.RollupStore(spark, f"{stages.root}/store"), slim)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(_table(spark, sf_dir, "documents"), lambda: alignment.byte_level(first), lambda: alignment.pieces(second))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_vectors(_table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_revisits": op3_revisits,
    "op4_token_rollup": op4_token_rollup,
    "op4_token_rollup_words": op4_token_rollup_words,
    "op5_html_extraction": op5_html_extraction,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_minhash": op8_minhash,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_quality_rules": op12_quality_rules,
    "op13_hard_negatives": op13_hard_negatives,
}
#: Results that SQL can state. Tokenizing, parsing, hashing and trained models are tested otherwise.
ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_revisits": revisits.ORACLE_SQL,
    "op4_token_rollup_words": token_rollup.WORDS_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op8_minhash": minhash.ORACLE_SQL,
    "op12_quality_rules": quality.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
