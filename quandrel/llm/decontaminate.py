"""Benchmark decontamination: find windows of benchmark items in documents, wherever they stand.

Plan.  A window is a set of (word, offset) shingles that a document must contain whole, so its necessary prefix is one
shingle: the rarest by the word's count over all documents.  Document words are joined with those prefix words; the offset
gives where the window would start, bounds on start and length drop what can't fit, and what is left is verified word by
word against the document, inside the same stage as the join.  The prefix table is broadcast only after its rows were
counted; a larger one is joined by shuffling (document, position, word) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quandrel.llm.staging import staged
from quandrel.llm.text import lower_az, names_beside, sha256_hex

#: Bytes that separate words: all of ASCII but digits and letters.  Fixed value of the contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A prefix table of at most so many rows (some 300 bytes each) is broadcast.
BROADCAST_ROWS = 200_000


def split_words(text: Column) -> Column:
    """Words of A-Z lower-cased text, with an empty first or last entry where the text begins or ends with separators."""
    return F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def word_count(words: Column) -> Column:
    """Number of words in what split_words() returns."""
    return (F.size(words) - (words[0] == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, words): each window once an item; an item of fewer words, but not none, is one window."""
    words = items.filter(F.col("item_id").isNotNull()).select("item_id", F.array_remove(split_words(F.col("text")), "").alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    starts = words.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return starts.select("item_id", F.slice("w", F.col("i"), F.col("n")).alias("words")).distinct()


def prefix_table(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(word, offset, window_id, words): each distinct window under its rarest word."""
    distinct = windows.select("window_id", "words").dropDuplicates(["window_id"])  # its id tells a window's words
    shingles = distinct.select("window_id", "words", F.posexplode("words").alias("offset", "word"))
    vocabulary = shingles.select("word").distinct()
    tokens = docs.select(F.explode(split_words(F.col("text"))).alias("word"))
    counted = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").agg(F.count("*").alias("uses"))
    counts = staged(counted, "counts")  # as a table, so that AQE can split a word of many windows
    # a window with a word that no document has occurs nowhere: the inner join and the count of its words drop it
    ranked = shingles.join(counts, "word").groupBy("window_id").agg(F.count("*").alias("found"), F.first("words").alias("words"), F.min(F.struct("uses", "word", "offset")).alias("rarest"))
    return ranked.filter(F.col("found") == F.size("words")).select("rarest.word", "rarest.offset", "window_id", "words")


def window_hits(docs: DataFrame, prefix: DataFrame, small: bool) -> DataFrame:
    """(doc_id, row_hash, start, n, window_id): every occurrence; ``docs`` has doc_id, row_hash and text."""
    rows = docs.select("doc_id", "row_hash", split_words(F.col("text")).alias("doc_words"))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.size("words") <= F.size("doc_words"))
    same = F.slice("doc_words", start + 1, F.size("words")) == F.col("words")
    if small:
        tokens = rows.select("doc_id", "row_hash", "doc_words", F.posexplode("doc_words").alias("pos", "word"))
        found = tokens.join(F.broadcast(prefix), "word")
    else:
        tokens = rows.select("doc_id", "row_hash", F.posexplode("doc_words").alias("pos", "word"))
        candidates = tokens.join(prefix, "word").filter(start >= 0).select("doc_id", "row_hash", "pos", "offset", "window_id", "words")
        found = candidates.join(rows.dropDuplicates(["doc_id", "row_hash"]), ["doc_id", "row_hash"])
    return found.filter(fits).filter(same).select("doc_id", "row_hash", start.alias("start"), F.size("words").alias("n"), "window_id")


def covered(spans: Column) -> Column:
    """Positions in the union of an array of (start, n)."""
    step = lambda a, x: F.struct(
        F.greatest(a["upto"], x["start"] + x["n"]).alias("upto"), (a["total"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["upto"], x["start"]))).alias("total")
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total")), step, lambda a: a["total"]).cast("long")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted as strings) and contaminated added.

    A window is ``width`` consecutive words of an item, or all words of an item of fewer; a document word inside any
    occurrence of a window is hit.  Null or empty text has no words and no hits; items without words, or whose id is null,
    hit nothing; items that repeat an id count once.  Rows that repeat a doc_id are judged each by its own text.  Rows of
    a null doc_id are judged too.  Other columns pass through, whatever they are named.
    """
    rest = docs.drop("n_words", "n_hit", "item_ids", "contaminated")
    own_id, own_row, hit_id, hit_row = names_beside(rest.columns, "own_id", "own_row", "hit_id", "hit_row")
    mine = rest.withColumns({own_row: F.xxhash64(F.coalesce("text", F.lit(""))), own_id: F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    keyed = mine.select(F.col(own_id).alias("doc_id"), F.col(own_row).alias("row_hash"), "text")
    phrase = F.array_join("words", " ")
    windows = staged(item_windows(items, width).withColumn("window_id", F.struct(F.xxhash64(phrase).alias("h1"), F.xxhash64(F.lit(5), phrase).alias("h2"))), "windows")
    n_windows = windows.count()
    small = n_windows * width <= BROADCAST_ROWS
    hits = staged(window_hits(keyed, prefix_table(keyed, windows, small), small), "hits")
    spans = hits.groupBy("doc_id", "row_hash").agg(covered(F.collect_set(F.struct("start", "n"))).alias("n_hit"))
    owners = windows.select("window_id", "item_id")
    owned = hits.select("doc_id", "row_hash", "window_id").distinct().join(F.broadcast(owners) if small else owners, "window_id").groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = spans.join(owned, ["doc_id", "row_hash"]).select(F.col("doc_id").alias(hit_id), F.col("row_hash").alias(hit_row), "n_hit", "item_ids")
    counted = mine.withColumn("n_words", word_count(split_words(F.col("text"))))
    joined = counted.join(found, (F.col(own_id) == F.col(hit_id)) & (F.col(own_row) == F.col(hit_row)), "left")
    out = joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop(own_id, own_row, hit_id, hit_row)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), sha256_hex(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS t FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
next AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM words),
hits AS (
  SELECT DISTINCT x.doc_id, x.pos, x.n, win.item_id
  FROM (SELECT doc_id, pos, n, array_to_string(l[1:n], ' ') AS t FROM next, sizes WHERE len(l) >= n) x JOIN win ON x.t = win.t AND x.n = win.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
