"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a grouped prefix join.

Plan.
1. Count shingles over all documents in a sketch of fixed size.  Its counts give the one global order, rare first; any
   fixed order keeps the join exact, and this one keeps shared passages out of prefixes.
2. A document's prefix is its n - ceil(t n) + 1 rarest shingles.  Documents with the same prefix and size are one group,
   and groups are what the large shuffle by shingle carries; shingles of one group only go, the rest expand to classes
   (distinct sets; copies of a document are one class).
3. Bounds on size and on position, then on the overlap by 1024-bit parity signatures, drop pairs; the sets of what is left
   are compared.  First each class meets two sets under each of its shingles: the smallest, which has least besides a passage
   that they share, and that in which the shingle stands first; the links found are components.  Then only pairs that share a shingle and are in different components are
   compared, shingles of the same classes counting as one, so that a large group of near copies is never expanded into all
   pairs, while no pair that could join two components is left out.

No step has a cap.  Sets are 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quandrel.llm import arrays
from quandrel.llm.components import components
from quandrel.llm.staging import light_batches, staged

#: The sketch has so many counters, in so many slices: 8 MB whatever the input.
COUNTERS, SLICES = 1 << 22, 64
#: A list of at most so many text hashes (8 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 16 bits: all that their order needs."""
    return np.minimum(np.round(2048 * np.log2(counts + 1.0)), 65535).astype(np.uint16)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents have a shingle under each counter, over all of ``docs``, coded."""
    width = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, sets in arrays.shingle_sets(batch.column(0), k):
                if sets:
                    np.add.at(total, counter_of(np.concatenate(sets)), np.uint32(1))
        for i in range(SLICES):
            part = total[i * width : (i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.astype(np.min_scalar_type(part.max())).tobytes()], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(i, np.zeros(width, np.uint64))
                total[i] += np.frombuffer(raw, f"u{len(raw) // width}").astype(np.uint64)
        for i, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([coded(part).tobytes()], pa.binary())], ["slice", "counts"])

    parts = docs.select("text").mapInArrow(arrays.freeing(count), "slice int, counts binary").repartition("slice").mapInArrow(arrays.freeing(add), "slice int, counts binary")
    whole = np.zeros(COUNTERS, np.uint16)
    for row in parts.collect():  # at most SLICES rows of 128 KB
        whole[row.slice * width : (row.slice + 1) * width] = np.frombuffer(row.counts, np.uint16)
    return whole


def set_keys(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(arrays.mix(found).sum(dtype=np.uint64)), int(arrays.mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def profiles(docs: DataFrame, counts: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """A row for each of ``docs`` (doc_id, th, text): set size and keys, prefix, prefix keys, parity signature."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            for lo, sets in arrays.shingle_sets(batch.column(2), k):
                keys, prefixes, signatures = [], [], []
                for found in sets:
                    n = len(found)
                    prefix = found[np.argsort(count[counter_of(found)], kind="stable")[: n - -(-num * n // den) + 1]] if n else found
                    keys.append((*set_keys(found), *set_keys(prefix)))
                    prefixes.append(prefix)
                    signatures.append(np.packbits((np.bincount((found & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).astype(bool)).view(np.int64))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x])]), pa.int32()), pa.array(np.concatenate(x).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(sets)), batch.column(1).slice(lo, len(sets)), pa.array([len(x) for x in sets], pa.int32()), *(signed([x[i] for x in keys]) for i in range(4)), lists(prefixes), lists(signatures)],
                    ["doc_id", "th", "n", "k1", "k2", "g1", "g2", "prefix", "signature"],
                )

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("th long, n int, k1 long, k2 long, g1 long, g2 long, prefix array<long>, signature array<long>").fields])
    return docs.select("doc_id", "th", "text").mapInArrow(arrays.freeing(run), schema).withColumn("uid", F.monotonically_increasing_id())


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class_id, found): the sets of ``wanted`` (class_id, th, n, k1, k2), read again from the texts."""
    hashes = wanted.select("th").distinct()
    chosen = docs.join(F.broadcast(hashes) if wanted.count() <= BROADCAST_ROWS else hashes, "th", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in arrays.shingle_sets(batch.column(0), k):
                keys = [set_keys(x) for x in sets]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sets], pa.int32()), signed([x[0] for x in keys]), signed([x[1] for x in keys]), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], ["n", "k1", "k2", "found"])

    return wanted.select("class_id", "n", "k1", "k2").join(chosen.select("text").mapInArrow(arrays.freeing(run), "n int, k1 long, k2 long, found array<long>"), ["n", "k1", "k2"]).dropDuplicates(["class_id"]).select("class_id", "found")


def link_finder(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> Callable[[DataFrame], DataFrame]:
    """A function from pairs (a, b) of classes to those that link."""
    def side(x: str) -> DataFrame:
        return classes.select(F.col("class_id").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))

    def find(pairs: DataFrame) -> DataFrame:
        left = staged(pairs.join(side("a"), "a").join(side("b"), "b").filter(could_overlap(num, den)).select("a", "b", "na", "nb"), "pairs")
        if left.isEmpty():
            return left.select("a", "b")
        ends = left.select(F.col("a").alias("class_id")).union(left.select("b")).distinct()
        sets = staged(sets_of(docs, classes.join(ends, "class_id", "left_semi"), k), "sets")
        both = left.join(sets.select(F.col("class_id").alias("a"), F.col("found").alias("fa")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("found").alias("fb")), "b")
        common = F.size(F.array_intersect("fa", "fb"))
        return both.filter(den * common >= num * (F.col("na") + F.col("nb") - common)).select("a", "b")

    return find


def could_link(num: int, den: int) -> Column:
    """Bounds on pairs with sizes na, nb and positions pa, pb of a common shingle in the global order."""
    size = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    most = 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    return size & (most * (num + den) >= num * (F.col("na") + F.col("nb")))


def could_overlap(num: int, den: int) -> Column:
    """A bound on the common shingles of sets of sizes na, nb from their parity signatures sa, sb."""
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.col("na") + F.col("nb") - apart) / 2 >= F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / (num + den) - 1e-9)


def one_of_alike(lists: DataFrame) -> DataFrame:
    """``lists`` (token, class_id, n, pos, root) with one token for all that the same classes have, as those of a passage.

    The first of them in the global order stands for all, so a pair has the positions of its first common one.
    """
    of = lists.groupBy("token").agg(F.count("*").alias("uses"), F.bit_xor(F.xxhash64("class_id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(5), "class_id")).alias("h2"))
    least = staged(of, "alike")
    named = lists.select("token", "class_id", "n", "pos", "root").join(least, "token").withColumn("group", F.xxhash64("uses", "h1", "h2"))
    return named.groupBy("group", "class_id").agg(F.min("pos").alias("pos"), F.first("n").alias("n"), F.first("root").alias("root")).withColumnRenamed("group", "token")


def similar_classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): a profile row for each document with its class_id; (node, root) of the classes that have links."""
    rows = staged(profiles(docs, sketch(docs, k), k, num, den), "profiles")
    some = rows.filter("n > 0")
    keyed = staged(some.groupBy("n", "k1", "k2").agg(F.min("uid").alias("class_id")), "sets-of")  # as a table, so that AQE can split the copies of one text
    classes = staged(some.join(keyed.select("class_id"), F.col("uid") == F.col("class_id")).select("class_id", "th", "n", "k1", "k2", "g1", "g2", "signature"), "classes")
    grouped = staged(classes.groupBy("n", "g1", "g2").agg(F.min("class_id").alias("group_id"), F.count("*").alias("size")), "groups")
    members = classes.select("class_id", "n", "g1", "g2").join(grouped, ["n", "g1", "g2"]).select("group_id", "class_id", "n", "size")
    prefixes = some.select("uid", "n", "prefix").join(grouped.select("group_id"), F.col("uid") == F.col("group_id")).select("group_id", "n", F.posexplode("prefix").alias("pos", "token"))
    # of two groups under a shingle, sizes too far apart can't link; more groups wait for the bounds on pairs
    common = prefixes.groupBy("token").agg(F.count("*").cast("int").alias("uses"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    common = common.filter(F.expr(f"uses > 2 or (uses = 2 and {den} * lo >= {num} * hi)")).select("token")
    met = prefixes.drop("n").join(common.hint("shuffle_hash"), "token").join(members, "group_id").select("token", "class_id", "n", "pos")
    inside = members.filter("size > 1").select(F.xxhash64("group_id", "n").alias("token"), "class_id", "n", F.lit(0).alias("pos"))
    lists = staged(met.unionByName(inside), "lists")

    # two hubs a shingle: the smallest set has least besides it, so what else shares a passage is likest to it; the set in
    # which it stands first has fewest shingles of its own, as a text has of which the others are altered copies
    hub = [F.col("n").alias("na"), F.col("class_id").alias("a"), F.col("pos").alias("pa")]
    first = lists.groupBy("token").agg(F.min(F.struct(*hub)).alias("small"), F.min(F.struct(hub[2], hub[0], hub[1])).alias("plain"))
    both = first.select("token", F.inline(F.array_distinct(F.array(F.struct("small.na", "small.a", "small.pa"), F.struct("plain.na", "plain.a", "plain.pa")))))
    hubs = staged(both, "first-hubs")
    star = lists.select("token", F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")).join(hubs, "token").filter("a <> b").filter(could_link(num, den)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    find = link_finder(docs, classes, k, num, den)
    tried = staged(star, "star")
    links = staged(find(tried), "links")
    roots = staged(components(links), "roots")
    named = rows.join(keyed, ["n", "k1", "k2"], "left").select("doc_id", "th", "n", "class_id")

    at = lists.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    mixed = staged(at.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token"), "mixed")
    if mixed.isEmpty():  # all that share a shingle are one component
        return named, roots
    # sizes of a pair that may link differ by less than one band, so each band meets itself and the next
    band = F.floor(F.ln("n") / math.log(den / num)).cast("int")
    apart = one_of_alike(staged(at.join(mixed, "token"), "apart"))
    left = staged(apart.join(classes.select("class_id", "signature"), "class_id").withColumn("band", band), "signed")
    a = left.select("token", "band", F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"), F.col("signature").alias("sa"))
    b = left.select("token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb"), F.col("signature").alias("sb"))
    ordered = F.expr("(na < nb or (na = nb and a < b)) and ra <> rb")
    met_again = a.join(b, ["token", "band"]).filter(ordered).filter(could_link(num, den)).filter(could_overlap(num, den))
    rest = met_again.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = staged(find(rest), "more")
    if more.isEmpty():  # no two components meet
        return named, roots
    return named, components(links.union(more))


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, root) for each row of ``docs``; th is xxhash64 of the text.

    root numbers the component, also where all of its doc_ids are null; it is null for the empty set.  Words are runs of anything but space and U+0009 to U+000D, A-Z lower-cased.  A document's set has its distinct ``k``-word
    shingles; with fewer words the whole sequence is one.  Documents link when den * intersection >= num * union, and
    component_id is the smallest doc_id that links reach.

    Null, empty or blank text has the empty set and links with nothing: its component_id is its own doc_id.  Equal texts
    link.  Rows that repeat a doc_id are judged each by its own text and give a row each.  A null doc_id is never a
    component_id unless its component has no other.  No rows in, no rows out.  Other columns play no part.
    """
    light_batches(docs.sparkSession)
    mine = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows, roots = similar_classes(mine, k, num, den)
    labelled = staged(rows.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", "th", "n", F.coalesce("root", "class_id").alias("root")), "labelled")
    # as a table, so that AQE can split the rows of a large component
    least = staged(labelled.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return labelled.join(least, "root", "left").select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "root")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; of rows that repeat it, one.

    Rows without words have no component and all stay; of a component whose ids are all null, one row stays.
    """
    named = lambda x: F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit(""))
    groups = jaccard_groups(docs, k, num, den)
    mine = groups.filter("n_shingles > 0 and doc_id <=> component_id").groupBy("root", "component_id", "th").agg(F.count("*").alias("rows"))
    best = mine.groupBy("root", "component_id").agg(F.min(F.struct("th", "rows")).alias("b"))
    chosen = staged(best.select(named("component_id").alias("_id"), F.col("b.th").alias("_th"), F.col("b.rows").alias("_rows")), "chosen")
    few = chosen.count() <= BROADCAST_ROWS  # then texts aren't shuffled
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), named("doc_id").alias("_id"), blank.alias("blank"))

    def held(of: DataFrame) -> DataFrame:
        return keyed.filter("not blank").join(F.broadcast(of) if few else of, ["_id", "_th"], "left_semi")

    once = held(chosen.filter("_rows = 1"))
    repeated = held(chosen.filter("_rows > 1")).dropDuplicates(["_id", "_th"])
    return once.unionByName(repeated).unionByName(keyed.filter("blank")).select("document.*")


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w),
runs AS (
  SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l,
    count(*) OVER (PARTITION BY doc_id) AS n FROM words),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(l, ' ')) AS s FROM runs WHERE len(l) = 4 OR (n < 4 AND pos = 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
