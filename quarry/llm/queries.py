"""The operators' queries over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, chat, codes, html, huffman, mixing, quality, runs, simhash, tiff, topk, urlfilter, warc
from quarry.llm.common import table

#: The public tokenizer that the contracts name.
WORD_BPE = "word_bpe_49k.json"


def vocabulary(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read_files(spark, huffman.token_files(spark, table(spark, sf_dir, "documents"), vocabulary()))


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.features(tiff.media(table(spark, sf_dir, "documents")))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_hostile(spark, table(spark, sf_dir, "conversations"))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(spark, table(spark, sf_dir, "documents"), mixing.Mix())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(spark, table(spark, sf_dir, "documents"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.report(spark, table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spark, table(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, table(spark, sf_dir, "embeddings"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_tiff, op3_html, op4_warc, op5_bpe, op6_chat, op7_mixing, op8_simhash, op9_urlfilter, op10_quality, op11_topk, op12_runs, op13_codes)}
SQL = {"op6_chat": chat.sql(), "op7_mixing": mixing.sql(mixing.Mix()), "op9_urlfilter": urlfilter.sql(), "op10_quality": quality.sql(), "op11_topk": topk.sql(), "op13_codes": codes.sql()}
