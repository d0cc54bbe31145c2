"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but
the last return the columns of documents.  Every stage gives an empty table for
an empty one; each states what it does with nulls and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import decision_list, exact_dedup, mixing, ngram_join, packing
from cellweave.llm.common import removed, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base conditions or the learned decision list reject go.

    Null and empty texts fail the base conditions.  Null doc_ids and repeated
    rows are judged like any.  Without labels the base conditions alone decide.
    """
    judged = decision_list.judge(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return judged.where("kept").select(*[F.col("_kept").getField(c).alias(c) for c in COLUMNS])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null counts as the empty text; a null doc_id stays only where no equal text
    has an id; rows repeated with one doc_id and text stay once.
    """
    return exact_dedup.keep_one(docs.select(*COLUMNS), keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links the one with the smallest doc_id stays.

    Null doc_ids, and null or empty texts, are linked with nothing and stay;
    rows repeated with the doc_id that stays all stay.
    """
    return ngram_join.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null text: size 0.  Null source: a source of its own, the last.  Null or
    repeated doc_ids: rows are decided apart.
    """
    return mixing.repeat(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences.

    Null text: the end id alone.  Null or repeated doc_ids: packed row by row.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned rules, the cube method's draw and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on documents; between stages the rows go to a Parquet table in the shared folder, so none is computed twice.

    A table goes once the next stage's is written, and all go if a stage fails;
    the last stage has cut its lineage.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    try:
        for number, (_, stage) in enumerate(STAGES, 1):
            docs, before = stage(spark, docs, sf_dir), path
            if number < len(STAGES):
                docs, path = written(docs)
                if before:
                    removed(spark, before)
    finally:
        if path:
            removed(spark, path)
    return docs
