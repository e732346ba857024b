"""A corpus pipeline: quality, repeated lines, near-duplicates, source mix, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the
columns of documents. Between stages the rows are written and read again, so each stage starts from
a table and a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm import cotrain, line_dedup, merge_dropout, mixing, shingles
from lumenfield.llm.queries import vocabulary
from lumenfield.llm.util import save, table

#: No SQL: classifiers are trained, near-duplicates are closed to components, pieces are merged.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go."""
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; n_chars follows the text."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that 5-word shingles of Jaccard similarity 0.8 or more link stays; candidates by SimHash, completed by min-hashes."""
    return shingles.shingle_dedup(docs, width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces and n_pieces, by seeded merge-dropout."""
    return merge_dropout.encode_docs(docs, vocabulary(spark, "piece_bpe_32k.model"), rate=0.1, seed=1)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs)
    return docs
