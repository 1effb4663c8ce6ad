"""A corpus from raw documents: quality, shared lines, near copies, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns of
documents; run() writes each stage's rows to the shared folder before the next reads them, and then deletes the tables
that the stage itself had staged.

Common to all stages: columns besides doc_id and text pass through whatever they are named, for stages work beside them;
no rows in, no rows out; rows that repeat a doc_id are judged each by its own text unless the stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quandrel.llm import decontaminate, jaccard, line_dedup, pieces, quality
from quandrel.llm.staging import area, staged


def beside(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` of ``docs``, and the whole row as the struct ``document``."""
    return docs.select(*keys, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quality.classify() rejects go; labels are those of the tables.

    Null and empty texts go.  A text whose score equals its threshold stays.  Rows of a null doc_id are judged by their text.
    Rows that repeat a doc_id and a text share their fate.  Texts of any length are scored whole.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents or more hold stay in the last of them; n_chars follows the text.

    Null text becomes ''.  Rows of a null doc_id keep all lines.  Rows that repeat a doc_id count as one document.
    """
    out = line_dedup.dedup_lines(beside(docs, "doc_id", "text"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return out.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"document.`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more stays, that of the smallest doc_id.

    Texts without words (null, empty, blank) are like nothing and all stay.  Of rows that repeat a doc_id and a text, and of
    a group whose ids are all null, one row stays.
    """
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go.  Null and empty texts hold none and stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(beside(docs, "doc_id", "text"), items).filter(~F.col("contaminated")).select("document.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, their number, and whether they decode to the text.

    Null and empty texts have no ids and come back as ''.  Every row gives a row.  Columns named ids, n_tokens and round_trip
    are replaced, and text goes.
    """
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip")]
    others = [F.struct(*(F.col(f"`{c}`") for c in rest)).alias("document")] if rest else []
    rows = pieces.encode(docs.select("text", *others), pieces.load(), decoded="decoded")
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return rows.select(*(F.col(f"document.`{c}`") for c in rest), "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", shared_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", tokens),
]

#: Perplexities and BPE merges aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with area(spark):
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
