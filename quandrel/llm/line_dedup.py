"""Line dedup: lines that many documents share stay in one document.

Plan.  A document's long lines become 128-bit hashes.  Rows (hash, document, position) are range-partitioned by hash and
document slice, and sorted by hash, document and position in each partition.  The slice is part of the range's key, so
that one line in a third of all documents is cut into several ranges; each task streams its sorted
rows, sees the first occurrence of a line in each document, and sends one row a line: documents seen and the last of
them.  The sums name the shared lines.  What goes back to the documents is a bitmap of kept positions, 64 to a word, with
a word only where some line goes; texts aren't shuffled before that last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quandrel.llm.staging import staged
from quandrel.llm.text import lower_az, names_beside, sha256_hex, strip_white

#: Documents are dealt in so many slices.
SLICES = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row_hash, lines array of (pos, h1, h2)): the long lines of each row.  Rows without any are left out."""

    def entry(line: Column, pos: Column) -> Column:
        key = lower_az(strip_white(line))
        return F.struct(pos.alias("pos"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), (F.length(strip_white(line)) >= min_chars).alias("long"))

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), F.filter(F.transform(lines_of(F.col("text")), entry), lambda x: x["long"]).alias("lines"))
    return rows.filter(F.size("lines") > 0)


def shared_lines(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, last_doc) of lines that at least ``min_docs`` documents hold; ``occurrences`` has h1, h2, doc_id, pos."""
    dealt = occurrences.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"))
    parts = dealt.repartitionByRange("h1", "slice").sortWithinPartitions("h1", "slice", "h2", "doc_id", "pos")
    run = W.partitionBy("h1", "slice", "h2").orderBy("doc_id", "pos")
    first = parts.withColumn("first", F.lag("doc_id").over(run).isNull() | (F.lag("doc_id").over(run) != F.col("doc_id")))
    seen = first.filter("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_doc"))
    return seen.filter(F.col("n") >= min_docs).select("h1", "h2", "last_doc")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row_hash, words map word -> 64 bits): in word w, bit b is set where line 64 w + b goes.

    A word without any such line is absent; rows that keep all lines are absent.
    """
    lines = staged(line_hashes(docs.filter(F.col("doc_id").isNotNull()), min_chars), "lines")
    occurrences = lines.select("doc_id", "row_hash", F.inline("lines")).drop("long")
    shared = staged(shared_lines(occurrences.drop("row_hash"), min_docs), "shared")  # as a table, so that AQE can split a common line
    gone = occurrences.join(shared, ["h1", "h2"]).filter(F.col("doc_id") < F.col("last_doc"))
    words = gone.groupBy("doc_id", "row_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("doc_id", "row_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased.  Keys of ``min_chars`` code points or
    more that ``min_docs`` documents or more hold lose all their lines except in the largest doc_id that holds them.

    Null or empty text is one empty line, and is kept as ''.  Rows of a null doc_id keep every line and don't count.  Rows
    that repeat a doc_id count as one document, and each is cut by its own positions.  Other columns pass through,
    whatever they are named, but for the three that are added.
    """
    mine = docs.drop("kept_text", "n_lines", "n_dropped")
    of_doc, of_row, bitmap = names_beside(mine.columns, "of_doc", "of_row", "bitmap")
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(of_doc), F.col("row_hash").alias(of_row), F.col("words").alias(bitmap))
    joined = mine.join(bitmaps.hint("shuffle_hash"), (F.col("doc_id") == F.col(of_doc)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(of_row)), "left")
    bit = lambda i: F.getbit(F.element_at(bitmap, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))) == 1
    kept = F.filter(lines_of(F.col("text")), lambda x, i: ~F.coalesce(bit(i), F.lit(False)))
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    dropped = F.coalesce(F.aggregate(F.map_values(bitmap), F.lit(0), lambda a, b: a + F.bit_count(b)), F.lit(0)).cast("long")
    out = joined.withColumns({"kept_text": F.when(F.col(bitmap).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")), "n_lines": n_lines, "n_dropped": dropped})
    return out.drop(of_doc, of_row, bitmap)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id < s.last_doc AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
