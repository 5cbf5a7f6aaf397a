"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import decontamination, divergence, html_text, jaccard, lexical, packing, pii, quality, secrets, token_file, toxicity, urls, warc
from kgloom.llm.common import table


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids in static range-ANS blocks, written, read back and digested."""
    out = token_file.corpus_dir(spark)
    token_file.write_corpus(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_file.read_corpus(spark, out, with_ids=False)


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)


def op3_pii_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text, disguised ones too, by offsets in the source."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text by pattern and by randomness."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents: a row for each document and item."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return urls.judged(table(spark, sf_dir, "pages"))


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op10_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written in chunks and read back."""
    out = warc.archive_dir(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), out)
    return warc.read_records(spark, out)


def op12_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set each source apart."""
    return divergence.audited(table(spark, sf_dir, "documents"))


def op13_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_file, op2_best_two_fit, op3_pii_transducers, op4_randomness_battery, op5_simhash_windows, op6_page_differencing, op7_markov_ratio, op8_rule_cascade, op9_subsequence_svm, op10_part_enum, op11_chunked_records, op12_heavy_light, op13_inverted_treaps)}


def oracle_sql() -> dict[str, str]:
    return {"op7_markov_ratio": urls.ORACLE_SQL, "op8_rule_cascade": quality.ORACLE_SQL, "op11_chunked_records": warc.ORACLE_SQL, "op12_heavy_light": divergence.ORACLE_SQL, "op13_inverted_treaps": lexical.ORACLE_SQL}
