"""Interpolated modified Kneser-Ney over characters, per language, as sharded tables that grow with the texts they count.

A gram is ORDER symbols of 21 bits in two longs: a has the model and the first two, b the last three; 0 stands for the
places before a shorter gram.  Symbols are code points as written; digits are one symbol, and so is white space but the line
feed.  A model is a language's number, doubled, plus 1 for the model of what is to be told apart from good text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quandrel.llm import arrays
from quandrel.llm.staging import area, staged

ORDER, BITS = 5, 21
#: Bytes of text that one step works on.
STEP_BYTES = 1 << 18
BEGIN = 1
SYMBOL = (1 << BITS) - 1
#: Languages are numbered by hash, 1 to this; 0 is all languages.
LANGUAGES = (1 << BITS - 2) - 1
#: A task holds so many distinct grams before it sends them.
HELD = 1 << 18
#: Words of fewer letters aren't looked at one by one.
WORD = 4
#: Nats that a word must be likelier under the other model to count, and words that a text is taken to have besides its own.
MARGIN, MORE_WORDS = 2.0, 30
_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of texts: BEGIN four times, then a symbol a character."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    points[(points < 33) & (points != 10)] = 32
    points[(points >= 48) & (points < 58)] = 48
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    sizes, pad = np.diff(before), ORDER - 1
    out_offsets = np.concatenate([[0], np.cumsum(sizes + pad)])
    out = np.full(out_offsets[-1], BEGIN, np.int64)
    out[np.arange(before[-1]) + np.repeat(pad * np.arange(1, len(sizes) + 1), sizes)] = points
    return out, out_offsets


def grams(symbol: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, row) of the gram that ends at each symbol but the padding; ``model`` has a number for each row."""
    sizes = np.diff(offsets) - (ORDER - 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    end = np.arange(len(row)) + (ORDER - 1) * (row + 1)
    s = [symbol[end - j] for j in range(ORDER)]
    return model[row] << 2 * BITS | s[4] << BITS | s[3], s[2] << 2 * BITS | s[1] << BITS | s[0], row


def text_grams(texts: pa.Array, models: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, a, b, row) of successive row ranges."""
    data, offsets = arrays.texts(texts)
    numbers = models.to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in arrays.steps(offsets, STEP_BYTES):
        yield lo, hi - lo, *grams(*symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), numbers[lo:hi])


def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return arrays.mix(arrays.mix(a.astype(np.uint64)) + b.astype(np.uint64))


def runs(a: np.ndarray, b: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): an order that brings equal grams together, and where each run begins in it."""
    keys = key(a, b) if keys is None else keys
    order = np.argsort(keys)
    sorted_ = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(a) else order


def batch_of(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def merged(parts: Iterator[dict[str, np.ndarray]], add: dict) -> Iterator[pa.RecordBatch]:
    """Parts with columns a and b, and those of ``add``, as rows of distinct grams: a task holds HELD of them at a time."""

    def once(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order, first = runs(columns["a"], columns["b"])
        out = {c: columns[c][order][first] for c in ("a", "b")}
        return out | {c: f.reduceat(columns[c][order], first) for c, f in add.items()}

    held: list[dict[str, np.ndarray]] = []
    for part in parts:
        if len(part["a"]):
            held.append(once(part))
        if sum(len(x["a"]) for x in held) > 2 * HELD:
            held = [once({c: np.concatenate([x[c] for x in held]) for c in held[0]})]
            if len(held[0]["a"]) > HELD:
                yield batch_of(held.pop())
    if held:
        yield batch_of(once({c: np.concatenate([x[c] for x in held]) for c in held[0]}))


def count_grams(training: DataFrame) -> DataFrame:
    """(a, b, c, lo, hi) over all of ``training`` (model, th, text): count, smallest and largest th of the texts that hold it."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            th = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, a, b, row in text_grams(batch.column(2), batch.column(0)):
                yield {"a": a, "b": b, "c": np.ones(len(a), np.int64), "lo": th[lo + row], "hi": th[lo + row]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged(parts(batches), {"c": np.add, "lo": np.minimum, "hi": np.maximum})

    rows = training.select("model", "th", "text").mapInArrow(arrays.freeing(run), "a long, b long, c long, lo long, hi long")
    return rows.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def distinct_grams(docs: DataFrame, part: bool = False) -> DataFrame:
    """(a, b): the distinct grams of ``docs`` (model, text, ...); with ``part``, of each of its parts, and the part."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for _, _, a, b, _ in text_grams(batch.column(1), batch.column(0)):
                yield {"a": a, "b": b}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not part:
            yield from merged(parts(batches), {})
            return
        for batch in batches:
            numbers = batch.column(2).to_numpy(zero_copy_only=False)
            for number in np.unique(numbers):
                mine = batch.filter(pa.array(numbers == number))
                for found in merged(parts(iter([mine])), {}):
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array(np.full(found.num_rows, number, np.int32))], ["a", "b", "part"])

    rows = docs.select("model", "text", *(["part"] if part else []))
    return rows.mapInArrow(arrays.freeing(run), "a long, b long" + (", part int" if part else "")).distinct()


def model_of() -> Column:
    return F.shiftright("a", 2 * BITS)


def suffix(n: int) -> tuple[Column, Column]:
    """The last ``n`` symbols of a gram."""
    mask = (1 << BITS * max(0, n - 3)) - 1
    a = F.shiftleft(model_of(), 2 * BITS).bitwiseOR(F.col("a").bitwiseAND(F.lit(mask)))
    return a, F.col("b").bitwiseAND(F.lit((1 << BITS * min(3, n)) - 1))


def context() -> tuple[Column, Column]:
    """A gram without its last symbol: its place is 0."""
    return F.col("a"), F.shiftleft(F.shiftright("b", BITS), BITS)


def discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3): what is taken off counts of 1, of 2, and of more, from the counts of counts of each model."""
    of = counts.groupBy(model_of().alias("model")).agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / F.greatest(F.lit(1), F.col("n1") + 2 * F.col("n2"))
    take = lambda i: F.least(F.lit(float(i)), F.greatest(F.lit(0.0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.lit(1), F.col(f"n{i}"))))
    return of.select("model", *(take(i).alias(f"d{i}") for i in (1, 2, 3)))


def order_tables(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (a, b, c, lo, hi) of each gram and (ca, cb, total, d1, d2, d3, left, left1) of each context.

    Below the highest order, c is the number of distinct symbols before a gram.  A context's discounts are its model's;
    left is the weight that the lower order gets, left1 that without grams that one text alone holds.
    """
    tables, now = [], counts
    for n in range(ORDER, 0, -1):
        ca, cb = context()
        rows = now.withColumns({"model": model_of(), "ca": ca, "cb": cb}).join(discounts(now), "model").withColumn("off", discount())
        left = F.sum("off") / F.sum("c")
        of_context = [F.sum("c").alias("total"), *(F.first(f"d{i}").alias(f"d{i}") for i in (1, 2, 3)), left.alias("left"), F.when(F.min("lo") == F.max("hi"), 1.0).otherwise(left).alias("left1")]
        tables.append((now, staged(rows.groupBy("ca", "cb").agg(*of_context), f"contexts-{n}")))
        if n > 1:
            a, b = suffix(n - 1)
            now = staged(now.select(a.alias("a"), b.alias("b"), "lo", "hi").groupBy("a", "b").agg(F.count("*").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), f"counts-{n - 1}")
    return tables[::-1]


def discount() -> Column:
    return F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))


def log_probabilities(wanted: DataFrame, tables: list) -> DataFrame:
    """(a, b, p, p1) of ``wanted`` (a, b): natural logarithms, with all texts of the model and without a gram's only one.

    A symbol that the model never saw has what order 1 leaves, as one symbol more.
    """
    letters = tables[0][0].groupBy(model_of().alias("model")).agg(F.count("*").alias("letters"))

    def of_order(n: int) -> DataFrame:
        """q and q1 of the last n symbols; the order below is deleted once it was read."""
        a, b = suffix(n)
        mine = (wanted if n == ORDER else wanted.select(a.alias("a"), b.alias("b")).distinct()).select("a", "b")
        with area(wanted.sparkSession):
            if n == 1:
                even = 1 / (F.coalesce("letters", F.lit(0)) + 1)
                mine = mine.withColumn("model", model_of()).join(letters, "model", "left").select("a", "b", even.alias("q"), even.alias("q1"))
            else:
                sa, sb = suffix(n - 1)
                mine = mine.withColumns({"sa": sa, "sb": sb}).join(of_order(n - 1).withColumnsRenamed({"a": "sa", "b": "sb"}), ["sa", "sb"]).drop("sa", "sb")
            ca, cb = context()
            grams, totals = tables[n - 1]
            rows = mine.withColumns({"ca": ca, "cb": cb}).join(totals, ["ca", "cb"], "left").join(grams, ["a", "b"], "left")
            share = (F.col("c") - discount()) / F.col("total")
            value = lambda s, w, q: F.coalesce(s, F.lit(0.0)) + F.coalesce(F.col(w), F.lit(1.0)) * F.col(q)
            q, q1 = value(share, "left", "q"), value(F.when(F.col("lo") < F.col("hi"), share), "left1", "q1")
            named = (q.alias("q"), q1.alias("q1")) if n < ORDER else (F.ln(q).cast("float").alias("p"), F.ln(q1).cast("float").alias("p1"))
            return staged(rows.select("a", "b", *named), f"probabilities-{n}", keep=True)

    return of_order(ORDER)


def gram_scores(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, p, p1, t, t1) of the grams of ``docs``: p and p1 by a language's good model, t and t1 by its other one, or null without any."""
    tables = order_tables(counts)
    step = 1 << 2 * BITS
    other = tables[0][0].select(model_of().alias("model")).filter("model & 1 = 1").distinct()
    with area(docs.sparkSession):
        found = staged(distinct_grams(docs), "grams")
        twins = found.withColumn("model", model_of() + 1).join(other, "model").select((F.col("a") + F.lit(step)).alias("a"), "b")
        wanted = staged(found.unionByName(twins), "wanted", keep=True)
    both = log_probabilities(wanted, tables)
    odd = model_of().bitwiseAND(F.lit(1)) == 1
    return both.filter(~odd).join(both.filter(odd).select((F.col("a") - F.lit(step)).alias("a"), "b", F.col("p").alias("t"), F.col("p1").alias("t1")), ["a", "b"], "left")


def word_bounds(b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, plain) of the runs of WORD letters or more; plain ones stand alone or by common punctuation."""
    s = b & SYMBOL
    letter = (s < 1 << 16) & _LETTER[np.minimum(s, 65535)]
    edge = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    inside = np.concatenate([[False], letter[:-1]]) & ~edge
    start = np.flatnonzero(letter & ~inside)
    after = np.concatenate([~letter[1:] | edge[1:], [True]]) if len(row) else edge
    end = np.flatnonzero(letter & after) + 1
    long = end - start >= WORD
    start, end = start[long], end[long]
    if not len(start):
        return start, end, np.zeros(0, bool)
    white = lambda i: (s[i] == 32) | (s[i] == 10)
    open_, close = np.maximum(start - 1, 0), np.minimum(end, len(s) - 1)
    plain = (edge[start] | white(open_) | np.isin(s[open_], [34, 39, 40])) & ((end == len(s)) | edge[close] | white(close) | np.isin(s[close], [33, 34, 39, 41, 44, 46, 58, 59, 63]))
    return start, end, plain


class Table:
    """Grams' logarithms of probability by key."""

    def __init__(self, a, b, *values):
        keys = key(np.asarray(a), np.asarray(b))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.stack([np.asarray(x, np.float32)[order] for x in values], axis=1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """[gram, (p, p1, t, t1)]: each distinct gram is looked up once."""
        keys = key(a, b)
        order, first = runs(a, b, keys)
        found = self.values[np.searchsorted(self.keys, keys[order[first]])]
        out = np.empty((len(a), self.values.shape[1]), np.float32)
        out[order] = np.repeat(found, np.diff(np.append(first, len(a))), axis=0)
        return out


def scores(texts: pa.Array, models: pa.Array, trusted: np.ndarray, toxic: np.ndarray, table: Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(perplexity, worst word, contrast) of texts; those of a model by what it holds without what they alone hold.

    The worst word is the largest mean surprise of a word's letters.  Contrast adds up by how much over MARGIN words are
    likelier under the other model, a word of the text.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0),) * 3]
    for lo, n, a, b, row in text_grams(texts, models):
        if not len(a):
            parts.append((np.full(n, np.nan),) * 3)
            continue
        value = table.of(a, b)
        good = np.where(trusted[lo + row], value[:, 1], value[:, 0]).astype(np.float64)
        other = np.where(toxic[lo + row], value[:, 3], value[:, 2]).astype(np.float64)
        size = np.bincount(row, minlength=n)
        mean = np.where(size > 0, np.exp(-np.bincount(row, good, n) / np.maximum(size, 1)), np.nan)
        start, end, plain = word_bounds(b, row)
        sums = np.concatenate([[0.0], np.cumsum(good)])
        worst = np.full(n, -np.inf)
        np.maximum.at(worst, row[start[plain]], -(sums[end[plain]] - sums[start[plain]]) / (end - start)[plain])
        gain = np.concatenate([[0.0], np.cumsum(np.nan_to_num(other - good))])
        over = np.maximum(gain[end] - gain[start] - MARGIN, 0)
        contrast = np.bincount(row[start], over, n) / (np.bincount(row[start], minlength=n) + MORE_WORDS)
        lacks = np.bincount(row, np.isnan(other), n) > 0
        parts.append((mean, np.where(np.isinf(worst), np.nan, worst), np.where(lacks | (size == 0), np.nan, contrast)))
    return tuple(pa.array(x := np.concatenate(c), mask=np.isnan(x)) for c in zip(*parts))


def score_documents(docs: DataFrame, training: DataFrame, most: int) -> DataFrame:
    """``docs`` (doc_id, lang, th, model, trusted, toxic, text) with perplexity, worst_word and contrast instead of model and text.

    ``training`` (model, th, text) has the texts of all models.  Up to ``most`` distinct grams of all documents are
    broadcast with their probabilities; more are grouped with the texts, each part of the documents with its own grams.
    """
    with area(docs.sparkSession):
        table = staged(gram_scores(docs, staged(count_grams(training), "counts")), "gram-scores", keep=True)
    kept = ["doc_id", "lang", "th", "trusted", "toxic"]
    schema = docs.select(*kept).schema.add("perplexity", "double").add("worst_word", "double").add("contrast", "double")
    names = ("a", "b", "p", "p1", "t", "t1")

    def columns(rows: pa.RecordBatch | pa.Table, table: Table) -> list:
        text, model, *own = (rows.column(x) for x in ("text", "model", "trusted", "toxic"))
        text, model = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (text, model))
        return [*(rows.column(x) for x in kept), *scores(text, model, *(x.to_numpy().astype(bool) if isinstance(x, pa.ChunkedArray) else x.to_numpy(zero_copy_only=False).astype(bool) for x in own), table)]

    if table.count() <= most:
        got = table.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(Table(*(got.column(x).to_numpy() for x in names)))
        del got

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(columns(batch, shared.value), schema.names)

        return docs.mapInArrow(arrays.freeing(run), schema)
    parted = staged(docs.withColumn("part", F.spark_partition_id()), "parted")
    mine = distinct_grams(parted, part=True).join(table, ["a", "b"])

    def grouped(texts: pa.Table, found: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(columns(texts, Table(*(found.column(x).to_numpy() for x in names))), schema.names)

    return parted.groupBy("part").cogroup(mine.groupBy("part")).applyInArrow(grouped, schema)
