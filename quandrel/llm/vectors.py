"""Embedding near-dedup by collision counting on sorted one-dimensional projections.

Plan.  Vectors of one label and length are put on many random lines.  Two vectors of cosine c differ on a line by a normal
variable of variance 2 - 2c, so a window of a few deviations around a query holds a partner with a known chance; the number
of lines on which a pair must meet is the largest that keeps the recall of a pair at the threshold.  The first line also
deals the work: its cells are as wide as its window, so a pair is in one cell or in two that touch, and cells are cut
into blocks of bounded size that meet two at a time.  A block pair sorts each line, counts the windows' collisions as
matrices, verifies the pairs that pass in double precision, and returns a row a vector (links, one edge), never its pairs.
Copies of a vector are one vector with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quandrel.llm.components import components
from quandrel.llm.staging import staged

#: Lines, half width of a window in deviations, that of the line that deals, recall that the count is calibrated to.
LINES, WIDTH, DEAL_WIDTH, RECALL = 16, 2.0, 4.0, 0.9999
#: Vectors in a block, about.
BLOCK = 1024


def needed_collisions(lines: int = LINES, width: float = WIDTH, recall: float = RECALL) -> int:
    """The most collisions that a pair at the threshold reaches with a chance of ``recall``."""
    p = math.erf(width / math.sqrt(2))
    tail, need = 0.0, 0
    for k in range(lines, -1, -1):
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        need = k
        if tail >= recall:
            break
    return need


def directions(dim: int, lines: int = LINES + 1) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((dim, lines))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision, of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # squares of large and small values stay finite
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def cells(vectors: DataFrame, deviation: float) -> DataFrame:
    """``vectors`` (id, label, embedding, ...) with dim and cell."""
    width = DEAL_WIDTH * deviation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            sizes = pa.compute.list_value_length(lists).to_numpy()
            cell = np.zeros(len(sizes), np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                cell[at] = np.floor(unit(lists.take(pa.array(at))) @ directions(int(dim))[:, 0] / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cell)], [*batch.schema.names, "dim", "cell"])

    return vectors.mapInArrow(run, vectors.select("*", F.lit(0).alias("dim"), F.lit(0).cast("long").alias("cell")).schema)


def collisions(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """For each pair of rows, the lines on which b's value lies in the window around a's."""
    count = np.zeros((len(a), len(b)), np.int8)
    for line in range(a.shape[1]):
        order = np.argsort(b[:, line], kind="stable")
        line_up = b[order, line]
        rank = np.empty(len(b), np.int16)
        rank[order] = np.arange(len(b), dtype=np.int16)
        lo = np.searchsorted(line_up, a[:, line] - width, "left").astype(np.int16)
        hi = np.searchsorted(line_up, a[:, line] + width, "right").astype(np.int16)
        count += (rank >= lo[:, None]) & (rank < hi[:, None])
    return count


def block_links(table: pa.Table, threshold: float, deviation: float, need: int) -> pa.Table:
    """(id, links, root) for the vectors of one block pair that have links in it; side 0 meets side 1, or side 2 itself."""
    ids, times, side = table["id"].to_numpy(), table["times"].to_numpy(), table["side"].to_numpy()
    lists = table["embedding"].combine_chunks()
    x = unit(lists if isinstance(lists, pa.Array) else lists.chunk(0))
    lines = x @ directions(x.shape[1])[:, 1:]
    alone = bool(len(side) and side[0] == 2)
    left, right = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    ends: list[np.ndarray] = []
    for lo in range(0, len(left), BLOCK):
        for lo2 in range(0, len(right), 8 * BLOCK):
            i, j = left[lo : lo + BLOCK], right[lo2 : lo2 + 8 * BLOCK]
            p, q = np.nonzero(collisions(lines[i], lines[j], WIDTH * deviation) >= need)
            p, q = i[p], j[q]
            if alone:
                p, q = p[p < q], q[p < q]
            for cut in range(0, len(p), 1 << 16):
                u, v = p[cut : cut + (1 << 16)], q[cut : cut + (1 << 16)]
                near = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                ends.append(np.stack([u[near], v[near]]))
    p, q = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    np.add.at(links, p, times[q])
    np.add.at(links, q, times[p])
    while True:
        low = np.minimum(root[p], root[q])
        before = root.copy()
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        if (root == before).all():
            break
    some = links > 0
    return pa.table({"id": ids[some], "links": links[some], "root": root[some]})


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, label, embedding).

    Rows of one label, not null, link when the cosine of their embeddings, in double precision, is ``threshold`` (over 0)
    or more.  Embeddings that are null, empty, all zero, or hold a null or a value that isn't finite link with nothing, and
    so do those of another length.  n_links counts other rows, copies too; component_id is the smallest vec_id that links
    reach; kept says whether that is the row's own.  Rows that repeat a vec_id count as rows.  Other columns play no part.
    """
    deviation = math.sqrt(2 - 2 * threshold)
    need = needed_collisions()
    good = F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
    good &= F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = staged(vectors.select("vec_id", "label", "embedding", good.alias("good")).withColumn("uid", F.monotonically_increasing_id()), "rows")
    copies = rows.filter("good").groupBy("label", "embedding").agg(F.min("uid").alias("id"), F.count("*").alias("times"), F.min("vec_id").alias("least"))
    placed = staged(cells(copies, deviation), "placed")

    at = W.partitionBy("label", "dim").orderBy("cell")
    near = lambda f, step: F.when(f("cell", 1).over(at) == F.col("cell") + step, f("parts", 1).over(at)).otherwise(0)
    counts = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    counts = counts.withColumns({"before": near(F.lag, -1), "after": near(F.lead, 1)})
    part = placed.join(counts, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    series = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("part")
    unit_of = lambda cell, kind, s, t, side: F.struct(cell.alias("at"), F.lit(kind).alias("kind"), s.alias("s"), t.alias("t"), side.cast("int").alias("side"))
    units = F.concat(
        F.transform(series(F.col("parts")), lambda t: unit_of(F.col("cell"), 0, F.least(mine, t), F.greatest(mine, t), F.when(t == mine, 2).when(mine < t, 0).otherwise(1))),
        F.transform(series(F.col("after")), lambda t: unit_of(F.col("cell"), 1, mine, t, F.lit(0))),
        F.transform(series(F.col("before")), lambda t: unit_of(F.col("cell") - 1, 1, t, mine, F.lit(1))),
    )
    dealt = part.select("label", "dim", "id", "times", "embedding", F.explode(units).alias("u")).select("label", "dim", "id", "times", "embedding", "u.*")
    met = staged(dealt.groupBy("label", "dim", "at", "kind", "s", "t").applyInArrow(lambda t: block_links(t, threshold, deviation, need), "id long, links long, root long"), "met")

    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    judged = placed.select("id", "label", "times", "least").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = judged.groupBy("root").agg(F.min("least").alias("component_id"))
    found = judged.join(smallest, "root").select("id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    names = rows.filter("good").select("vec_id", "label", "embedding").join(placed.select("label", "embedding", "id"), ["label", "embedding"]).select("vec_id", "id")
    out = names.join(found, "id").select("vec_id", "n_links", "component_id")
    rest = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM component c LEFT JOIN degree USING (vec_id)
"""
