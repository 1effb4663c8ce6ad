"""Suffix-array dedup: byte strings of L bytes or more that also start elsewhere, found by longest-previous-factor flags.

Plan.  Every string of L bytes contains the same anchor wherever it stands: the smallest hash of its k-byte grams
(winnowing).  Suffixes that can share L bytes therefore meet under one anchor hash, and the suffix array splits into one
small array for each anchor that occurs twice; anchors that occur once, most of them, need none.
1. One pass over the bytes gives each document's anchors, with a hash of the anchor's context (all L-byte strings over it).
2. Counts by anchor, then by context.  Instances with equal contexts are one entry of the array, held by its first
   instance; only anchors with several contexts need their bytes, which are read again for one instance a context.
3. Under an anchor the suffixes are put in order of the fingerprint of their first L bytes, ties by position: only factors
   of L or more matter, so this order has the same neighbours at that length as the order by bytes.  The neighbour before
   is the previous smaller position, the neighbour after the next one: they flag suffixes with an earlier match
   (LPF >= L) and with a later one.
4. An anchor with many contexts (a passage that many documents quote, at its ends) isn't put in one task: blocks of offsets
   are counted by hash over all tasks, from coarse to single offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quandrel.llm import arrays
from quandrel.llm.staging import light_batches, staged

#: Bytes of a gram; a window has L - GRAM + 1 grams, at most 256.
GRAM = 32
#: More contexts than this under one anchor are counted in blocks; a task's suffix array has about so many contexts.
MOST_CONTEXTS = 4096
BLOCK = 16


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in row, gram hash, context hash) of the anchors of all rows."""
    w = length - GRAM + 1
    n = len(data)
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if n < length or sizes.max() < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = arrays.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    grams = arrays.span_hash(prefix, at, at + GRAM)
    blocks = -(-len(grams) // w)
    keys = np.full(blocks * w, np.uint64(2**64 - 1))
    keys[: len(grams)] = (grams & ~np.uint64(255)) | (at % w).astype(np.uint64)
    square = keys.reshape(blocks, w)
    ahead = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(square, axis=1).ravel()
    ends = np.repeat(offsets[1:], sizes)
    start = np.flatnonzero(np.arange(n) + length <= ends)
    first, second = ahead[start], behind[start + w - 1]
    use_first = (first >> np.uint64(8)) <= (second >> np.uint64(8))
    where = np.where(use_first, start // w * w + (first & np.uint64(255)).astype(np.int64), (start + w - 1) // w * w + (second & np.uint64(255)).astype(np.int64))
    mark = np.zeros(n, bool)
    mark[where] = True
    found = np.flatnonzero(mark)
    row = np.searchsorted(offsets, found, "right") - 1
    left = np.maximum(found - (w - 1), offsets[row])
    right = np.minimum(found + length, offsets[row + 1])
    with np.errstate(over="ignore"):
        context = arrays.mix(arrays.span_hash(prefix, left, right) + (found - left).astype(np.uint64))
    return row, found - offsets[row], grams[found], context


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """(uid, doc_id, th, n_bytes, anchors): a row for each document with any anchor, uid unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.texts(batch.column(2))
            for lo, hi in arrays.steps(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                row, pos, gram, context = anchors_of(data[offsets[lo] : offsets[hi]], own, length)
                bounds = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                entries = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], ["pos", "gram", "context"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(own), pa.int32()), pa.ListArray.from_arrays(bounds, entries)], ["doc_id", "th", "n_bytes", "anchors"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("th long, n_bytes int, anchors array<struct<pos: int, gram: long, context: long>>").fields])
    return docs.select("doc_id", "th", "text").mapInArrow(arrays.freeing(run), schema).filter(F.size("anchors") > 0).withColumn("uid", F.monotonically_increasing_id())


def contexts_of(docs: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """(gram, context, left, bytes, doc_id, uid, pos, contexts) for ``firsts``: the bytes around each anchor.

    Rows of ``docs`` that are equal give a row each.
    """
    before = length - GRAM
    lists = firsts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "gram", "context", "uid", "contexts")).alias("wanted")).select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "wanted")
    joined = docs.join(lists.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(lists["_doc"]) & (docs["th"] == lists["_th"])).select("doc_id", "text", "wanted")
    cut = joined.select("doc_id", F.col("text").cast("binary").alias("raw"), F.inline("wanted"))
    from_ = F.greatest(F.lit(0), F.col("pos") - before)
    return cut.select("gram", "context", (F.col("pos") - from_).alias("left"), F.substring("raw", from_ + 1, F.col("pos") - from_ + length).alias("bytes"), "doc_id", "uid", "pos", "contexts")


def windows(left: np.ndarray, raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, offset, fingerprint) of every L-byte string over the anchors of some contexts."""
    sizes = np.array([len(x) for x in raw], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    prefix = arrays.prefix_hash(np.frombuffer(b"".join(raw), np.uint8))
    low = np.maximum(0, length - (sizes - left))
    many = np.maximum(0, left - low + 1)
    entry = np.repeat(np.arange(len(raw)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[entry]
    start = offsets[entry] + left[entry] - offset
    return entry, offset, arrays.span_hash(prefix, start, start + length)


def factor_flags(table: pa.Table, length: int) -> pa.RecordBatch:
    """Offsets with an earlier and with any match, for whole groups of contexts: the suffix arrays of some anchors.

    ``table`` has gram, context, left, bytes, doc_id, uid, pos of each context's first instance, sorted by the first two.
    """
    both = table["gram"].to_numpy(), table["context"].to_numpy()
    new = np.ones(table.num_rows, bool)
    new[1:] = (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1])
    table = table.filter(pa.array(new)).combine_chunks()
    gram, context = table["gram"].to_numpy(), table["context"].to_numpy()
    entry, offset, print_ = windows(table["left"].to_numpy().astype(np.int64), table["bytes"].to_pylist(), length)
    place = np.empty(table.num_rows, np.int64)
    place[pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("uid", "ascending"), ("pos", "ascending")]).to_numpy()] = np.arange(table.num_rows)
    with np.errstate(over="ignore"):
        key = arrays.mix(print_ + arrays.mix(gram[entry].view(np.uint64)) + offset.astype(np.uint64))  # equal strings over one anchor stand at one offset
    order = np.lexsort((place[entry], key))
    same = key[order][1:] == key[order][:-1]
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[order[1:]], later[order[:-1]] = same, same
    return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(context), spans(entry, offset, earlier, len(gram)), spans(entry, offset, earlier | later, len(gram))], ["gram", "context", "earlier", "other"])


def spans(entry: np.ndarray, offset: np.ndarray, flag: np.ndarray, rows: int) -> pa.ListArray:
    """For each entry its maximal runs [lo, hi] of flagged offsets; ``entry`` and ``offset`` are in order."""
    entry, offset = entry[flag], offset[flag]
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(entry)) - 1 if len(first) else first
    bounds = pa.array(np.searchsorted(entry[first], np.arange(rows + 1)), pa.int32())
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(offset[first], pa.int32()), pa.array(offset[last], pa.int32())], ["lo", "hi"]))


SPANS = "array<struct<lo: int, hi: int>>"


def small_arrays(contexts: DataFrame, length: int) -> DataFrame:
    """(gram, context, earlier, other) for anchors of at most MOST_CONTEXTS contexts: whole anchors in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= MOST_CONTEXTS:
                gram = held["gram"].to_numpy()
                whole = int(np.searchsorted(gram, gram[-1]))  # rows are sorted by gram; its last anchor may go on
                for lo in range(0, whole, 2 * MOST_CONTEXTS):
                    a, b = (int(np.searchsorted(gram, gram[min(x, whole - 1)])) if x < whole else whole for x in (lo, lo + 2 * MOST_CONTEXTS))
                    if b > a:
                        yield factor_flags(held.slice(a, b - a), length)
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield factor_flags(held, length)

    dealt = contexts.repartition("gram").sortWithinPartitions("gram", "context")
    return dealt.mapInArrow(arrays.freeing(run), f"gram long, context long, earlier {SPANS}, other {SPANS}")


def counted_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of more contexts, by counts over all tasks.

    A block of offsets whose common core occurs once has no match; a block whose outer string occurs twice matches
    at all its offsets, and earlier ones too for all holders but the first; the first, and other blocks, are counted offset
    by offset.
    """
    before = length - GRAM

    def hashes(single: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, raw = batch["left"].to_numpy().astype(np.int64), batch["bytes"].to_pylist()
                sizes = np.array([len(x) for x in raw], np.int64)
                base = np.concatenate([[0], np.cumsum(sizes)])[:-1] + left
                prefix = arrays.prefix_hash(np.frombuffer(b"".join(raw), np.uint8))
                low, n = np.maximum(0, length - (sizes - left)), len(raw)
                lists = batch["blocks"].to_pylist() if single else None
                for block in range(before // BLOCK + 1):
                    a, b = block * BLOCK, min(block * BLOCK + BLOCK - 1, before)
                    steps = [(o, o, 2 + o) for o in range(a, b + 1)] if single else [(a, b, 0), (b, a, 1)]
                    chosen = np.array([block in x for x in lists]) if single else np.ones(n, bool)
                    for o1, o2, kind in steps:
                        valid = chosen & ((left >= a) & (low <= b) if kind == 0 else (left >= o1) & (low <= o2))
                        i = np.flatnonzero(valid)
                        if len(i):
                            h = arrays.span_hash(prefix, base[i] - o1, base[i] - o2 + length)
                            yield pa.RecordBatch.from_arrays([batch["gram"].take(pa.array(i)), batch["context"].take(pa.array(i)), pa.array(np.full(len(i), block), pa.int32()), pa.array(np.full(len(i), kind), pa.int32()), pa.array(h.view(np.int64))], ["gram", "context", "block", "kind", "print"])

        return run

    def holders(rows: DataFrame) -> DataFrame:
        named = rows.join(places, ["gram", "context"])
        count = named.groupBy("gram", "block", "kind", "print").agg(F.count("*").alias("uses"), F.min("place").alias("first"))
        return named.join(count, ["gram", "block", "kind", "print"]).select("gram", "context", "block", "kind", (F.col("uses") > 1).alias("other"), (F.col("place") > F.col("first")).alias("earlier"))

    places = staged(contexts.select("gram", "context", F.struct("doc_id", "uid", "pos").alias("place")), "places")
    schema = "gram long, context long, block int, kind int, print long"
    coarse = staged(holders(contexts.select("gram", "context", "left", "bytes").mapInArrow(arrays.freeing(hashes(False)), schema)), "coarse")
    block = coarse.groupBy("gram", "context", "block").agg(F.max(F.when(F.col("kind") == 0, F.col("other"))).alias("core"), *(F.coalesce(F.max(F.when(F.col("kind") == 1, F.col(c))), F.lit(False)).alias(name) for c, name in (("earlier", "whole"), ("other", "shared"))))
    open_ = block.filter("core and not whole").groupBy("gram", "context").agg(F.collect_list("block").alias("blocks"))
    fine = holders(contexts.join(open_, ["gram", "context"]).select("gram", "context", "left", "bytes", "blocks").mapInArrow(arrays.freeing(hashes(True)), schema)).filter("other").select("gram", "context", (F.col("kind") - 2).alias("lo"), (F.col("kind") - 2).alias("hi"), "earlier")
    full = block.filter("shared").select("gram", "context", (F.col("block") * BLOCK).alias("lo"), F.least(F.col("block") * BLOCK + BLOCK - 1, F.lit(before)).alias("hi"), F.col("whole").alias("earlier"))
    span = F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
    return full.unionByName(fine).groupBy("gram", "context").agg(F.collect_list(F.when(F.col("earlier"), span)).alias("earlier"), F.collect_list(span).alias("other"))


def repeated_spans(docs: DataFrame, length: int, keep: str) -> DataFrame:
    """(doc_id, th, spans array of (start, end)): bytes to remove, spans may overlap.  ``docs`` has doc_id, th, text."""
    before = length - GRAM
    table = staged(anchor_table(docs, length), "anchors")
    anchors = table.select("uid", "n_bytes", F.inline("anchors"))
    often = anchors.groupBy("gram").agg(F.count("*").alias("uses"), F.min("context").alias("lo"), F.max("context").alias("hi")).filter("uses > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed"))
    again = staged(anchors.join(often.hint("shuffle_hash"), "gram"), "again")
    ids = table.select("uid", "doc_id", "th")
    firsts = staged(again.join(ids, "uid").groupBy("gram", "context", "mixed").agg(F.count("*").alias("uses"), F.min(F.struct("doc_id", "uid", "pos", "th")).alias("first")).select("gram", "context", "mixed", "uses", "first.*"), "firsts")
    mixed = firsts.filter("mixed")
    spread = mixed.groupBy("gram").agg(F.count("*").alias("contexts"))
    raw = staged(contexts_of(docs, mixed.join(spread, "gram"), length), "contexts")
    few = small_arrays(raw.filter(F.col("contexts") <= MOST_CONTEXTS), length)
    many = counted_blocks(staged(raw.filter(F.col("contexts") > MOST_CONTEXTS).dropDuplicates(["gram", "context"]), "many"), length)
    flags = few.unionByName(many)

    judged = firsts.select("gram", "context", "uses", F.col("uid").alias("first_uid"), F.col("pos").alias("first_pos")).join(flags, ["gram", "context"], "left")
    at = again.drop("mixed").join(judged, ["gram", "context"])
    lo, hi = F.greatest(F.lit(0), length - (F.col("n_bytes") - F.col("pos"))), F.least(F.col("pos"), F.lit(before))
    whole = F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))
    copies = F.col("uses") > 1 if keep == "none" else (F.col("uid") != F.col("first_uid")) | (F.col("pos") != F.col("first_pos"))
    found = F.coalesce("other" if keep == "none" else "earlier", F.array().cast(SPANS))
    offsets = F.filter(F.when(copies, whole).otherwise(found), lambda x: x["lo"] <= x["hi"])
    pieces = at.select("uid", "pos", F.explode(offsets).alias("o")).select("uid", F.struct((F.col("pos") - F.col("o.hi")).alias("start"), (F.col("pos") - F.col("o.lo") + length).alias("end")).alias("span"))
    return pieces.groupBy("uid").agg(F.collect_list("span").alias("spans")).join(ids, "uid").groupBy("doc_id", "th").agg(F.first("spans").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, keep: str = "none") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs``: its UTF-8 bytes without repeats.

    A byte goes if it is in a string of ``length`` bytes that also starts elsewhere, in this or another document; overlaps
    count.  With keep='first' a string stays where it first starts, by doc_id and position; keep='none' leaves no copy.
    ``length`` is GRAM + 1 to GRAM + 255.  Strings are judged on the input.

    Null text is empty; shorter texts than ``length`` keep all.  Each row counts as a document, so rows that repeat a
    doc_id with the same text are copies of each other, and get the same result.  A null doc_id is judged as any other.
    ``kept`` is binary, for a cut may split a character.  Extra columns play no part.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length is {GRAM + 1} to {GRAM + 255}")
    light_batches(docs.sparkSession)
    mine = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = repeated_spans(mine, length, keep).select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "spans")
    joined = mine.join(found.hint("shuffle_hash"), mine["doc_id"].eqNullSafe(found["_doc"]) & (mine["th"] == found["_th"]), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone, runs, sizes = [], [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                raw, parts, at, n, removed = text.encode(), [], 0, 0, 0
                upto = -1
                for x in sorted((x["start"], x["end"]) for x in found or ()):
                    if x[0] > upto:
                        parts.append(raw[at : x[0]])
                        n, removed, upto, at = n + 1, removed + x[1] - x[0], x[1], x[1]
                    elif x[1] > upto:
                        removed, upto, at = removed + x[1] - upto, x[1], x[1]
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                gone.append(removed)
                runs.append(n)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary").fields])
    return joined.mapInArrow(arrays.freeing(cut), schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
