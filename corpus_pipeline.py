"""From raw documents to token ids: rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame; all but the
last return the columns of ``documents``, with ``text`` and ``n_chars`` as the stage left them. Other columns are dropped
whatever their names, rows are judged one by one unless a stage says otherwise, texts are read whole, and an empty table
gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.decontaminate import drop_contaminated
from tidewire.llm.line_dedup import drop_repeated_lines
from tidewire.llm.near_copies import keep_first
from tidewire.llm.quality_rules import kept_rows
from tidewire.llm.sentence_pieces import encode_decode
from tidewire.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps. Null, empty and blank texts have too few words and go; repeated rows
    and a null id are judged as any other."""
    return kept_rows(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that an earlier document or line has nearly word for word. Null and empty texts stay as
    they are; identical rows are judged as one and all stay; rows of one id with different texts come one after the other, in
    the order of their texts' hashes; a null id comes last."""
    out = drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, by five-word shingles of similarity 0.8: that with the smallest id.
    Candidates share a SimHash class by deletion-variant signatures or a MinHash band; whole shingle sets decide.
    Null, empty and blank texts are one class; rows of one id with different texts are documents of their own,
    rows of one id and one text are one; a null id comes last."""
    return keep_first(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to 0.8 of its shingles. Null and empty texts and items match nothing; repeated
    rows go or stay together."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, by their number and digest, and the digest of the text decoded from them. A null text is an
    empty one, with the end id only; repeated rows give repeated results."""
    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", decontaminated), ("sentence_pieces", encoded)]

#: Connected components, MinHash search and BPE are not SQL; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
