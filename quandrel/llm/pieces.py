"""SentencePiece encoding and decoding by a lattice of pieces.

Plan.  The vocabulary is a BPE one: its ids come from merging the best pair again and again, which a best path through the
lattice doesn't give, so the fold over each word's edges merges pairs instead.  A batch of texts becomes its distinct words;
bounded-length substrings of those are exploded and matched with the piece table (fixed size, broadcast) by hash; the edges
lie grouped by word; the fold runs over all words at once.  Documents stay where they are: no shuffle, and no word of one
batch waits for another.  Ids decode in the worker that made them where both are wanted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quandrel.llm import arrays
from quandrel.llm.staging import light_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of more characters are folded one by one with a heap; bytes of text, and ids, that a step works on.  A step takes
#: some 150 times its bytes of memory, and smaller steps cost no more time.
LONG_WORD, STEP_BYTES = 64, 256 << 10
STEP_IDS = 1 << 18
NONE = np.int32(2**31 - 1)


@dataclass
class Pieces:
    """The piece table: text and id of pieces, best first, and the ids of bytes."""

    texts: list[str]
    ids: list[int]
    bytes_: list[int]
    names: list[bytes]  # what each id decodes to


def load(model: str = MODEL) -> Pieces:
    import sentencepiece

    table = sentencepiece.SentencePieceProcessor(model_file=model)
    n = table.vocab_size()
    plain = [i for i in range(n) if not (table.is_byte(i) or table.is_control(i) or table.is_unknown(i) or table.is_unused(i))]
    plain.sort(key=lambda i: (-table.get_score(i), i))
    byte = {int(table.id_to_piece(i)[3:5], 16): i for i in range(n) if table.is_byte(i)}
    if len(byte) != 256:
        raise ValueError("the vocabulary has no byte pieces")
    names = [b""] * n
    for i in plain:
        names[i] = table.id_to_piece(i).replace(SPACE, " ").encode()
    for b, i in byte.items():
        names[i] = bytes([b])
    return Pieces([table.id_to_piece(i) for i in plain], plain, [byte[b] for b in range(256)], names)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def code_hash(points: np.ndarray) -> np.ndarray:
    """As arrays.prefix_hash(), for code points."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(points.astype(np.uint64) + np.uint64(1)) * arrays.powers(len(points))[0][: len(points)], dtype=np.uint64)])


class Lattice:
    """The piece table in the form that joins with substrings: sorted hashes in buckets, ranks, ids."""

    SHIFT = np.uint64(44)

    def __init__(self, pieces: Pieces):
        self.longest = max(map(len, pieces.texts))
        sizes = np.array([len(x) for x in pieces.texts], np.int64)
        ends = np.cumsum(sizes)
        hashes = arrays.span_hash(code_hash(code_points("".join(pieces.texts))), ends - sizes, ends)
        order = np.argsort(hashes)
        self.hashes, self.ranks = hashes[order], order.astype(np.int32)
        # where the hashes of each value of the top bits begin: most buckets are empty, few have more than one
        self.first = np.searchsorted(self.hashes >> self.SHIFT, np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        self.ids = np.array(pieces.ids, np.int32)
        self.bytes = np.array(pieces.bytes_, np.int32)

    def edges(self, prefix: np.ndarray, end_of: np.ndarray) -> np.ndarray:
        """[start, length]: rank of the piece that is this substring, or NONE; no substring crosses its word's end."""
        n = len(end_of)
        out = np.full((n, self.longest + 1), NONE, np.int32)
        for size in range(1, self.longest + 1):
            start = np.flatnonzero(np.arange(n) + size <= end_of)
            h = arrays.span_hash(prefix, start, start + size)
            bucket = (h >> self.SHIFT).astype(np.int32)
            at, end = self.first[bucket], self.first[bucket + 1]
            some = np.flatnonzero(at < end)
            start, h, at, end = start[some], h[some], at[some], end[some]
            while len(start):
                hit = self.hashes[at] == h
                out[start[hit], size] = self.ranks[at[hit]]
                rest = np.flatnonzero(~hit & (at + 1 < end))
                start, h, at, end = start[rest], h[rest], at[rest] + 1, end[rest]
        return out

    def fold(self, edges: np.ndarray, starts: np.ndarray, end_of: np.ndarray) -> np.ndarray:
        """Length of the symbol that starts at each character, 0 inside symbols: one best merge a word and round."""
        n = len(end_of)
        size = np.ones(n, np.int64)
        lengths = np.diff(np.append(starts, n))
        word = np.repeat(np.arange(len(starts)), lengths)
        live = np.flatnonzero(lengths[word] <= LONG_WORD)
        while len(live):
            follow = live + size[live]
            inside = follow < end_of[live]
            pair = live[inside]
            merged = size[pair] + size[follow[inside]]
            fits = merged <= self.longest
            pair, merged = pair[fits], merged[fits]
            rank = edges[pair, merged]
            able = rank != NONE
            pair, rank, merged = pair[able], rank[able], merged[able]
            if not len(pair):
                break
            owner = word[pair]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank.astype(np.int64) * n + pair, first)
            chosen = best % n
            gone = chosen + size[chosen]
            size[chosen] += size[gone]
            size[gone] = 0
            again = np.zeros(len(starts), bool)
            again[owner[first]] = True
            live = live[again[word[live]] & (size[live] > 0)]
        for w in np.flatnonzero(lengths > LONG_WORD).tolist():
            self._long(edges, int(starts[w]), int(starts[w] + lengths[w]), size)
        return size

    def _long(self, edges: np.ndarray, lo: int, hi: int, size: np.ndarray) -> None:
        before = np.arange(lo - 1, hi - 1)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = i + int(size[i])
            if i >= lo and j < hi and size[i] + size[j] <= self.longest and (rank := int(edges[i, size[i] + size[j]])) != NONE:
                heapq.heappush(heap, (rank, i, int(size[i]), int(size[j])))

        for i in range(lo, hi - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if size[i] != a or i + a >= hi or size[i + a] != b:
                continue
            size[i], size[i + a] = a + b, 0
            if i + a + b < hi:
                before[i + a + b - lo] = i
                offer(i)
            if before[i - lo] >= lo:
                offer(int(before[i - lo]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        points = code_points("".join(marked))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in marked])]).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        gap = points == ord(SPACE)
        begins = gap.copy()
        begins[1:] &= ~gap[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(points))
        prefix = code_hash(points)
        _, first, inverse = np.unique(arrays.span_hash(prefix, start, end), return_index=True, return_inverse=True)
        # the distinct words, laid end to end
        lengths = (end - start)[first]
        word_start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        own = points[np.repeat(start[first] - word_start, lengths) + np.arange(lengths.sum())]
        end_of = np.repeat(word_start + lengths, lengths)
        edges = self.edges(code_hash(own), end_of)
        size = self.fold(edges, word_start, end_of)
        at = np.flatnonzero(size)
        rank = edges[at, size[at]]
        lone = rank == NONE  # a character that is no piece: its bytes
        n_bytes = np.where(own[at] < 0x80, 1, np.where(own[at] < 0x800, 2, np.where(own[at] < 0x10000, 3, 4)))
        count = np.where(lone, n_bytes, 1)
        token_start = np.concatenate([[0], np.cumsum(count)])
        tokens = np.empty(token_start[-1], np.int32)
        tokens[token_start[:-1][~lone]] = self.ids[rank[~lone]]
        if lone.any():
            raw = np.frombuffer(own[at[lone]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            tokens[np.repeat(token_start[:-1][lone] - np.concatenate([[0], np.cumsum(count[lone])])[:-1], count[lone]) + np.arange(len(raw))] = self.bytes[raw]
        by_word = token_start[np.searchsorted(at, np.append(word_start, len(own)))]
        many = np.diff(by_word)[inverse]
        total = np.concatenate([[0], np.cumsum(many)])
        ids = tokens[np.repeat(by_word[:-1][inverse] - total[:-1], many) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offsets)]


def decoding(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of what each id decodes to."""
    return np.frombuffer(b"".join(pieces.names), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in pieces.names])])


def decode_ids(names: tuple[np.ndarray, np.ndarray], ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of id lists: bytes of the pieces, without the space that encoding puts first; broken UTF-8 becomes U+FFFD."""
    data, at = names
    sizes = np.diff(at)[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    raw = data[np.repeat(at[:-1][ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
    bounds = ends[offsets].tolist()
    return [raw[a + (raw[a : a + 1] == b" " and b > a) : b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encoded(lattice: Lattice, batch: pa.RecordBatch, names: tuple[np.ndarray, np.ndarray] | None = None, into: str = "decoded") -> Iterator[pa.RecordBatch]:
    """``batch`` in steps, with the ids of its texts, and with their decoded texts if ``names`` are given."""
    column = batch.column(batch.schema.get_field_index("text"))
    _, offsets = arrays.texts(column)
    for lo, hi in arrays.steps(offsets, STEP_BYTES):
        ids, bounds = lattice.encode(column.slice(lo, hi - lo).to_pylist())
        new = {"ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))}
        if names is not None:
            new[into] = pa.array(decode_ids(names, ids, bounds), pa.string())
        yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *new.values()], [*batch.schema.names, *new])


def encode(docs: DataFrame, pieces: Pieces, decoded: str | None = None) -> DataFrame:
    """``docs`` with ids (array of int) added: SentencePiece ids of ``text``.

    Null and empty texts have no ids.  Whole texts of any length are encoded.  A column named ids is replaced; others pass
    through, repeated rows too.  ``decoded``: a column of this name has the texts that decode() makes of the ids, by the
    worker that encodes, so that a task needs one worker, not two.
    """
    light_batches(docs.sparkSession)
    mine = docs.drop("ids", *([decoded] if decoded else []))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, names = Lattice(shared.value), decoding(shared.value) if decoded else None
        for batch in batches:
            yield from encoded(lattice, batch, names, decoded)

    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return mine.mapInArrow(arrays.freeing(run), T.StructType([*mine.schema.fields, *new]))


def decode(rows: DataFrame, pieces: Pieces, into: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ``ids`` added; null ids give ''."""
    light_batches(rows.sparkSession)
    mine = rows.drop(into)
    shared = rows.sparkSession.sparkContext.broadcast(decoding(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy())]).astype(np.int64)
            ids = lists.flatten().to_numpy()
            for lo, hi in arrays.steps(bounds, STEP_IDS):
                texts = decode_ids(shared.value, ids[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(texts, pa.string())], [*batch.schema.names, into])

    return mine.mapInArrow(arrays.freeing(run), T.StructType([*mine.schema.fields, T.StructField(into, T.StringType())]))


def op6_sentencepiece(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = load(model)
    out = encode(docs, pieces, decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded", (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), SPACE, " ")).alias("round_trip"))
