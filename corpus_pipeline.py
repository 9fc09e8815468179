"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tsumugi.llm.common import MADE, drop_made, table, written
from tsumugi.llm.exact import drop_exact
from tsumugi.llm.mixing import mix
from tsumugi.llm.near import drop_similar
from tsumugi.llm.packing import pack, packed_columns
from tsumugi.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision posterior calls good, of any length; those with over half of their words in repeated
    windows go, and so do texts without words (null, empty, blank). Repeated rows are judged alike; no documents: none."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest id, null ids last; of rows that repeat id and text one. No documents: none."""
    return drop_exact(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 of five-word shingles: the smallest id, null ids last, ties by
    the text's hash. All texts without words are one group. No documents: none."""
    return drop_similar(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson number says, sources at equal shares, shuffled globally. Null is a source of its
    own; rows without id draw by a hash of all their columns. No documents: none."""
    return mix(docs).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens, copies apart. Null and empty texts are the closing id alone;
    rows that repeat an id are packed one by one. No documents: none."""
    return packed_columns(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: EM, fingerprints, components and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's pieces. Each stage's documents are written; then the tables it made on the way, and the documents of
    the stage before, are deleted. No documents: no pieces."""
    docs, before = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)  # the last table made
        drop_made(spark, before, len(MADE) - 1)
        before = len(MADE) - 1
    return STAGES[-1][1](spark, docs, sf_dir)
