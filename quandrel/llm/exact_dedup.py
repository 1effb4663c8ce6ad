"""Exact dedup: equal texts keep one document, however many copies one text has.

Plan.  Texts are normalised and digested.  Every sum is grouped by digest and whole text, so that two texts of one digest
never merge: (1) each task deduplicates its own rows, as the map side of the first sum; (2) that sum's groups are salted by
document, so that the copies of one text meet in several tasks; (3) the salts' winners, at most SALTS a text, are combined.
What leaves the third step has no text.  Documents then look their class up by digest.  A class of more than a HOT-th of
all rows is one of fewer than HOT, so these are broadcast; no other digest holds enough rows to fill a task.  Digests that
two different texts share, should there be any, are looked up by digest and whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quandrel.llm.staging import staged
from quandrel.llm.text import names_beside, sha256_hex

SALTS = 16
#: Classes of more than 1 / HOT of all rows are broadcast: there are fewer than HOT of them.
HOT = 1_000


def normalised(text: Column) -> Column:
    """Every run of space and U+0009 to U+000D becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(12), text).alias("h2")]


def salt_winners(texts: DataFrame) -> DataFrame:
    """(h1, h2, norm, keep_id, group_size) a text and salt, of ``texts`` (doc_id, norm)."""
    dealt = texts.select("doc_id", "norm", *digests(F.col("norm")), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SALTS)).alias("salt"))
    return dealt.groupBy("h1", "h2", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def classes_of(winners: DataFrame) -> DataFrame:
    """(h1, h2, norm, keep_id, group_size) a text: the salts' winners combined."""
    return winners.groupBy("h1", "h2", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def find_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text) added.

    Texts are equal when they are identical after each run of white space became one space.  Null counts as empty, so null
    and empty texts are one class; blank texts (one space) are another.  The row of the smallest doc_id stays.  Rows are
    told apart by doc_id alone: rows that repeat a doc_id and a text are all ``kept`` or all not, and each counts in
    ``group_size``.  A null doc_id is larger than any; a class that has no other has a null ``keep_id`` and keeps its rows.
    Texts of any length are compared whole.  Other columns pass through, whatever they are named, but for the four added.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    mine = docs.drop(*added)
    d1, d2, c1, c2, cnorm, cid, csize, csha = names_beside(mine.columns, "d1", "d2", "c1", "c2", "class_norm", "class_id", "class_size", "class_sha")
    norm = normalised(F.col("text"))
    texts = docs.select("doc_id", norm.alias("norm"))
    named = [F.col("h1").alias(c1), F.col("h2").alias(c2), F.col("keep_id").alias(cid), F.col("group_size").alias(csize), F.col("sha").alias(csha)]
    classes = staged(classes_of(salt_winners(texts)).select("h1", "h2", "keep_id", "group_size", sha256_hex(F.col("norm")).alias("sha")), "classes")
    sizes = classes.agg(F.sum("group_size"), F.count("*")).first()
    digest_counts = classes.groupBy("h1", "h2").agg(F.count("*").alias("texts"))
    clashing = [] if not sizes[1] else digest_counts.filter("texts > 1").limit(1).collect()
    rows = mine.withColumns(dict(zip((d1, d2), digests(norm))))
    same = (F.col(d1) == F.col(c1)) & (F.col(d2) == F.col(c2))
    if clashing:  # two texts of one digest: look up by whole text
        whole = classes_of(salt_winners(texts)).select("h1", "h2", "keep_id", "group_size", sha256_hex(F.col("norm")).alias("sha"), "norm").select(*named, F.col("norm").alias(cnorm))
        found = rows.join(whole, same & (norm == F.col(cnorm)), "left").drop(cnorm)
    else:
        large = F.col("group_size") * HOT > F.lit(sizes[0] or 0)
        hot = classes.filter(large).select(*named)
        rest = classes.filter(~large).select(*named)
        h = names_beside([*rows.columns, c1, c2, cid, csize, csha], *(f"hot_{i}" for i in range(5)))
        hot = hot.toDF(*h)
        by_hot = rows.join(F.broadcast(hot), (F.col(d1) == F.col(h[0])) & (F.col(d2) == F.col(h[1])), "left")
        found = by_hot.filter(F.col(h[0]).isNotNull()).withColumns(dict(zip((cid, csize, csha), (F.col(x) for x in h[2:])))).drop(*h)
        cold = by_hot.filter(F.col(h[0]).isNull()).drop(*h).join(rest, same, "left").drop(c1, c2)
        found = found.unionByName(cold)
    kept = F.col("doc_id").eqNullSafe(F.col(cid))
    return found.select(*(F.col(f"`{c}`") for c in mine.columns), F.col(cid).alias("keep_id"), F.col(csize).alias("group_size"), kept.alias("kept"), F.col(csha).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that find_copies() keeps, with their own columns."""
    return find_copies(docs).filter("kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
