"""A corpus pipeline of five operators; see STAGES.

run(spark, sf_dir) applies the stages to the documents table.  Each stage gets
what its predecessor kept, reread from Parquet in the shared folder; what a
stage saves on its way it deletes, and its input goes once its output is there.

Defined cases, for every stage: a null text is empty (line_dedup and the
filters keep it as null); other columns may be null and come out as they were;
texts of any length are judged whole; rows of equal doc_id and text are judged
alike, and near_dedup keeps one of them; ties go to the smallest doc_id; an
empty table gives no rows; columns other than those of documents are dropped,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import common, decontaminate, entry, lines, packing, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores at 0.3 or more go."""
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels").where(~entry.toxic_held_out()))
    scored = toxicity.score(docs, model, keep=["text", "lang", "source", "n_chars"])
    return scored.where(F.col("score") < entry.TOXIC_FROM).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document goes only if every line it had was a repeat of one that is kept."""
    out = lines.dedup_lines(docs, short=True)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return out.where(~emptied).select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.near_copies(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule names go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences."""
    return packing.pack(packing.pieces(docs, entry.tokenizer_path(), end_id=2)).drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The grammar, edit similarity groups and the tokenizer are not SQL; brute-force versions test the stages in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = common.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_saved(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
