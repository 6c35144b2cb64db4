"""The corpus pipeline: toxicity, quality rules, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one returns
is written as Parquet and read again as the next one's docs. All but the last
keep the columns of documents, extra ones and clashing names included.

Odd rows: null and empty texts pass the toxicity stage and fail the quality rules,
which want words. A null id matches no label. Repeated rows share their fate until
near-duplicates leave one of them; of a group's documents that of the smallest id
stays, one without id only if no other has one, and ties go to the smaller text
hash. Null languages and sources are values of their own. Every stage gives an
empty table for an empty one, and texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.bpe import encode_decode
from chronoframe.llm.common import materialized, table
from chronoframe.llm.mixing import sample_mixed
from chronoframe.llm.neardup import keep_one_of_each
from chronoframe.llm.quality import keep_good
from chronoframe.llm.toxicity import drop_toxic

#: Share of the tokens that the mixing stage keeps.
MIX_KEEP = 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic (operator 8)."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 6)."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (operator 7)."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics hold their target shares of tokens (operator 5)."""
    return sample_mixed(docs, keep=MIX_KEEP)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's text, decoded again as a check (operator 2)."""
    import public_tokenizers

    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("lang", "source", "text"))
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", exact.alias("decodes"))


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("MinHash near-dedup", near_dedup), ("mixing sources to target weights", mixing), ("BPE encoding and decoding", tokens)]

#: Models, components and merges are beyond SQL; tests/llm compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialized(docs)
    return docs
