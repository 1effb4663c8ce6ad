"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over the corpus.

Plan.  Tasks tokenise whole texts by both vocabularies.  A single space between two other characters is an anchor: tokens
of both vocabularies end before it and start with it, which the bytes of the tokens verify; anchors split a document into
windows of token ids.  Equal windows of a batch are tokenised and aligned once (one word has one id tuple, so the word is
the memo's key): offsets inside a window where both end cut it into groups, and a group links all its A tokens with all its
B tokens.  A document leaves its task as distinct id pairs with multiplicity, so that texts are read once.  Spark counts the
documents of each pair, finds the highest count of each A id (one row an id of the vocabulary, broadcast), and gives both
back to the documents: by a broadcast of up to FEW_PAIRS counted pairs, by a join on the pair beyond that.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quandrel.llm.staging import light_batches, staged

MODEL_A, MODEL_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A-B pairs of a group that are counted one by one.
EACH = 4_096
#: Bytes of text that are aligned at a time.
STEP_BYTES = 1 << 20
#: Distinct pairs (some 30 bytes each) that are broadcast; more are joined by shuffle.
FEW_PAIRS = 1_000_000
#: Split of a text before A's merges, as a ByteLevel pre-tokenizer does it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space on which a backtracking engine would overflow its stack.
LONG_WHITE = re.compile(r"\s{1000}")
LOOSE = re.compile(r"^\s|\s\Z")
ANCHOR = re.compile(r"(?<=\S) (?=\S)")
#: Decimal ids, each followed by ; , or |, and their digits.
NUMBER = [np.array([f"{i}{mark}" for i in range(1 << 16)], dtype="S6") for mark in ";,|"]
DIGITS = np.array([len(str(i)) for i in range(1 << 16)])


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class ByteBpe:
    """Vocabulary A.  Ids follow the merges, so they are ranks; a text with very long white space goes to the other library."""

    path: str

    @cached_property
    def tokens(self) -> list[bytes]:
        with open(self.path, encoding="utf-8") as f:
            table = json.load(f)
        chars, special = byte_of_char(), {x["id"] for x in table["added_tokens"]}
        vocab = {i: bytes(chars[c] for c in s) for s, i in table["model"]["vocab"].items() if i not in special}
        return [vocab.get(i, b"") for i in range(max(vocab) + 1)]

    @cached_property
    def fast(self):
        import tiktoken

        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.tokens) if t}, special_tokens={})

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def encode(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids if len(text) > 1000 and LONG_WHITE.search(text) else self.fast.encode_ordinary(text)


@dataclass
class Pieces:
    """Vocabulary B."""

    path: str

    @cached_property
    def model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @cached_property
    def tokens(self) -> list[bytes]:
        m = self.model
        return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.vocab_size())]


@dataclass
class Windows:
    """Alignment of distinct windows (the words of a batch): numbers and group text of each, and its distinct id pairs.

    Pairs of window w are those from ``first[w]`` to ``first[w + 1]``, as A << 16 | B, each with ``times`` links.
    """

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    texts: list[str]
    pairs: np.ndarray
    times: np.ndarray
    first: np.ndarray

    def taken(self, places: np.ndarray) -> Windows:
        """The windows at ``places``, in that order."""
        n = np.diff(self.first)[places]
        _, at = spread(self.first[places], n)
        texts = [self.texts[i] for i in places.tolist()]
        return Windows(self.good[places], self.n_a[places], self.n_b[places], self.n_groups[places], texts, self.pairs[at], self.times[at], np.append(0, n.cumsum()))


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``times`` of each."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.add.reduceat(times, starts) if len(keys) else times


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``sizes`` places from ``starts``: the run of each place, and the place."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


@dataclass
class Aligner:
    """Both vocabularies of a task."""

    a: ByteBpe
    b: Pieces

    def __post_init__(self) -> None:
        self.len_a, self.len_b = (np.array([len(t) for t in v.tokens], dtype=np.int64) for v in (self.a, self.b))
        self.cuts = not any(" " in t.lstrip(b" ").decode("utf-8", "replace") for t in self.b.tokens)

    def words(self, text: str) -> list[str]:
        """Windows of a text, each without the space before it: both vocabularies cut before a single space between others.

        A's split always does; B does where no piece has a space after another character, else a text is one window.
        """
        return ANCHOR.split(text) if self.cuts else [text]

    def windows(self, words: list[str]) -> Windows:
        """Alignment of distinct ``words``.  Those that white space neither begins nor ends are anchored on both sides in
        any text, so A encodes them in one call."""
        loose = [bool(LOOSE.search(w)) for w in words]
        if any(loose):
            order = sorted(range(len(words)), key=loose.__getitem__)
            back = np.argsort(order)
            return self.windows_of([words[i] for i in order], loose.count(False)).taken(back)
        return self.windows_of(words, len(words))

    def windows_of(self, words: list[str], n_firm: int) -> Windows:
        firm = "".join(f" {w}" for w in words[:n_firm])
        a_firm = np.array(self.a.encode(firm) if firm else [], dtype=np.int64)
        ends = np.cumsum([len(w.encode("utf-8", "replace")) + 1 for w in words[:n_firm]], dtype=np.int64)
        a = [self.a.encode(f" {w}") for w in words[n_firm:]]
        b = self.b.model.encode(words, num_threads=1) if words else []
        good = np.ones(len(words), dtype=bool)
        of_a, of_b, said = self.a.tokens.__getitem__, self.b.tokens.__getitem__, "".join(f" {w}" for w in words).encode("utf-8", "replace")
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        ids_a, ids_b = np.append(a_firm, np.fromiter(chain.from_iterable(a), np.int64)), np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        n_a = np.append(np.diff(np.searchsorted(self.len_a[a_firm].cumsum(), ends, "right"), prepend=0), [len(x) for x in a]).astype(np.int64)
        word_a, word_b = np.repeat(np.arange(len(words)), n_a), np.repeat(np.arange(len(words)), n_b)
        bytes_a, bytes_b = (np.bincount(w, n[i], len(words)) for w, n, i in ((word_a, self.len_a, ids_a), (word_b, self.len_b, ids_b)))
        if (bytes_a != bytes_b).any() or b"".join(map(of_a, ids_a.tolist())) != said or b"".join(map(of_b, ids_b.tolist())) != said:
            split_a = np.split(ids_a, n_a.cumsum()[:-1])
            good = np.array([b"".join(map(of_a, x.tolist())) == f" {w}".encode("utf-8", "replace") == b"".join(map(of_b, y)) for w, x, y in zip(words, split_a, b)], dtype=bool)
            ids_a, word_a, ids_b, word_b = ids_a[good[word_a]], word_a[good[word_a]], ids_b[good[word_b]], word_b[good[word_b]]
        ends_a, ends_b = self.len_a[ids_a].cumsum(), self.len_b[ids_b].cumsum()
        ends = np.zeros((2, int(ends_a[-1]) + 1 if len(ends_a) else 1), dtype=bool)
        ends[0, ends_a] = ends[1, ends_b] = True
        last_a, last_b = ends[1, ends_a], ends[0, ends_b]  # the last tokens of their groups
        to_a, to_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        from_a, from_b = np.append(0, to_a[:-1]) if len(to_a) else to_a, np.append(0, to_b[:-1]) if len(to_b) else to_b
        size_a, size_b = to_a - from_a, to_b - from_b
        word = word_a[to_a - 1]
        # group text: in each group A's ids, then B's, each id with the mark that follows it
        spelled = np.empty(len(ids_a) + len(ids_b), dtype="S6")
        spelled[np.arange(len(ids_a)) + np.repeat(from_b, size_a)] = NUMBER[1][ids_a] if not len(to_a) else np.where(last_a, NUMBER[2][ids_a], NUMBER[1][ids_a])
        spelled[np.arange(len(ids_b)) + np.repeat(to_a, size_b)] = NUMBER[1][ids_b] if not len(to_b) else np.where(last_b, NUMBER[0][ids_b], NUMBER[1][ids_b])
        chars = np.bincount(np.append(word_a, word_b), np.append(DIGITS[ids_a], DIGITS[ids_b]) + 1, len(words)).astype(np.int64).cumsum().tolist() if words else []
        flat = spelled.tobytes().translate(None, b"\0").decode()
        texts = [flat[i : j - 1] for i, j in zip([0, *chars[:-1]], chars)]
        # links: all of A with all of B in a group; a group of very many goes by its distinct ids
        each = size_a * size_b <= EACH
        run, place = spread(np.zeros(int(each.sum()), dtype=np.int64), (size_a * size_b)[each])
        n = size_b[each][run]
        keys = [word[each][run] << 32 | ids_a[from_a[each][run] + place // np.maximum(n, 1)] << 16 | ids_b[from_b[each][run] + place % np.maximum(n, 1)]]
        times = [np.ones(len(run), dtype=np.int64)]
        for g in np.flatnonzero(~each).tolist():
            (x, n_x), (y, n_y) = (np.unique(i[f[g] : t[g]], return_counts=True) for i, f, t in ((ids_a, from_a, to_a), (ids_b, from_b, to_b)))
            keys.append((word[g] << 32 | x[:, None] << 16 | y[None, :]).ravel())
            times.append((n_x[:, None] * n_y[None, :]).ravel())
        keys, times = summed(np.concatenate(keys), np.concatenate(times))
        first = np.searchsorted(keys, np.arange(len(words) + 1) << 32)
        return Windows(good, n_a, n_b, np.bincount(word, minlength=len(words)), texts, keys & 0xFFFFFFFF, times, first)

    def documents(self, texts: list[str | None]) -> list[pa.Array]:
        """The columns of COLUMNS, for a batch of texts."""
        split = [self.words(t) if t else [] for t in texts]
        place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        of_word = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64)
        of_doc = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        w = self.windows(list(place))
        good = np.bincount(of_doc, ~w.good[of_word], len(texts)) == 0
        good &= np.bincount(of_doc, minlength=len(texts)) > 0
        keep = good[of_doc]
        bounds = np.searchsorted(of_doc, np.arange(len(texts) + 1)).tolist()
        number = of_word.tolist()
        hashed = [hashlib.sha256(";".join(map(w.texts.__getitem__, number[i:j])).encode()).hexdigest() if ok else "" for i, j, ok in zip(bounds, bounds[1:], good.tolist())]
        of_word, of_doc = of_word[keep], of_doc[keep]
        total = lambda x: np.bincount(of_doc, x[of_word], len(texts)).astype(np.int64)
        held, n = summed(of_doc << 32 | of_word, np.ones(len(of_doc), dtype=np.int64))
        doc, window = held >> 32, held & 0xFFFFFFFF
        run, at = spread(w.first[window], w.first[window + 1] - w.first[window])
        found, count = summed(doc[run] << 32 | w.pairs[at], w.times[at] * n[run])
        first = pa.array(np.searchsorted(found, np.arange(len(texts) + 1) << 32), pa.int32())
        links = np.bincount(found >> 32, count, len(texts)).astype(np.int64)
        lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in ((found >> 16 & 0xFFFF).astype(np.int32), (found & 0xFFFF).astype(np.int32), count.astype(np.int64))]
        return [*(pa.array(x) for x in (total(w.n_a), total(w.n_b), total(w.n_groups), links)), pa.array(hashed, pa.string()), *lists]


def steps(texts: pa.Array) -> list[tuple[int, int]]:
    """Runs of texts of STEP_BYTES at most, or of one longer text."""
    sizes = np.nan_to_num(np.array(pc.binary_length(texts).to_pylist(), dtype=float))
    out, lo, total = [], 0, 0.0
    for i, n in enumerate(sizes):
        if i > lo and total + n > STEP_BYTES:
            out.append((lo, i))
            lo, total = i, 0.0
        total += n
    return out + [(lo, len(sizes))] if len(sizes) else []


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "link_a", "link_b", "link_n"]


def groups_of(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """``docs`` without text, and the token groups of each row: n_a, n_b, n_groups, n_links, groups_sha256, and the distinct
    linked id pairs as link_a, link_b with link_n links each."""
    light_batches(docs.sparkSession)
    added = COLUMNS
    mine = docs.drop(*added)
    rest = [c for c in mine.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteBpe(model_a), Pieces(model_b))
        for batch in batches:
            for lo, hi in steps(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + aligner.documents(part.column("text").to_pylist()), rest + added)

    numbers = [T.StructField(n, T.LongType()) for n in added[:4]] + [T.StructField(added[4], T.StringType())]
    lists = [T.StructField(n, T.ArrayType(k)) for n, k in zip(added[5:], (T.IntegerType(), T.IntegerType(), T.LongType()))]
    return mine.mapInArrow(run, T.StructType([mine.schema[c] for c in rest] + numbers + lists))


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, docs, best) a pair linked in any row of ``links`` (a, b): rows that hold it, and whether no pair of its a has more."""
    counts = staged(links.groupBy("a", "b").agg(F.count("*").alias("docs")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))  # a row an id of the vocabulary
    return counts.join(F.broadcast(top), "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))


def link_tokens(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """``docs`` without text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 added.

    A encodes a space and the text, B the text (it adds the space); strings of special tokens are plain text.  Null and empty
    texts, and texts whose tokens of A or B don't spell the space and the text (such as those with U+2581), have no tokens:
    zeros and ''.  A pair's count is the number of rows that hold it linked, so rows that repeat a doc_id, or have none, count
    each by itself.  ``n_best`` counts links whose pair's count is the highest of its A id, ties included; ``count_sum`` adds
    the counts of all links.  Texts of any length are tokenised whole; a group is counted by its distinct ids, so a long one
    costs no more than they do.  Other columns pass through, whatever they are named, but for text and the seven added.
    """
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kept = [c for c in docs.columns if c not in ("text", *added)]
    beside = docs.select(F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept))).alias("own"), "text")
    rows = staged(groups_of(beside, model_a, model_b).withColumn("row", F.monotonically_increasing_id()), "token-groups")
    links = rows.select("row", F.inline(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n"))))
    counts = staged(pair_counts(links.select("a", "b")), "pairs")
    few = counts.count() <= few_pairs
    scored = links.join(F.broadcast(counts) if few else counts.hint("merge"), ["a", "b"])
    sums = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = rows.drop("link_a", "link_b", "link_n").join(sums, "row", "left")
    new = [F.coalesce(c, zero).alias(c) if c in ("n_best", "count_sum") else F.col(c) for c in added]
    return out.select(*(F.col(f"own.c{i}").alias(c) for i, c in enumerate(kept)), *new)


def op11_token_links(spark, sf_dir: str) -> DataFrame:
    return link_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
