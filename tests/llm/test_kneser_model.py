import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quandrel.llm import kneser, quality


class Plain:
    """Interpolated modified Kneser-Ney by the textbook, with dictionaries of tuples."""

    def __init__(self, texts, order=5):
        self.order, self.levels = order, []
        counts = Counter(tuple(s[i - order + 1 : i + 1]) for s in map(self.padded, texts) for i in range(order - 1, len(s)))
        for n in range(order, 0, -1):
            of = Counter(counts.values())
            y = of[1] / max(1, of[1] + 2 * of[2])
            d = {i: min(i, max(0.0, i - (i + 1) * y * of[i + 1] / max(1, of[i]))) for i in (1, 2, 3)}
            total, off = defaultdict(int), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                off[g[:-1]] += d[min(c, 3)]
            self.levels.append((n, counts, d, total, off))
            counts = Counter(g[1:] for g in counts)
        self.letters = len(self.levels[-1][1])

    @staticmethod
    def padded(text):
        return [None] * 4 + ["0" if x in "0123456789" else x for x in text]

    def p(self, gram):
        q = 1 / (self.letters + 1)
        for n, counts, d, total, off in self.levels[::-1]:
            g = gram[len(gram) - n :]
            if total[g[:-1]]:
                c = counts.get(g, 0)
                q = (c - d[min(c, 3)] if c else 0) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * q
        return q

    def perplexity(self, text):
        s = self.padded(text)
        return math.exp(-sum(math.log(self.p(tuple(s[i - 4 : i + 1]))) for i in range(4, len(s))) / len(text))


def prose(r, n=40):
    return " ".join(r.choice(["the", "cat", "sat", "on", "mats", "a", "Anna", "café", "дом", "12", "7"]) for _ in range(n)) + "."


def test_equals_a_textbook_model(spark):
    r = random.Random(2)
    trusted = [(i, prose(r), "en") for i in range(30)]
    others = [(100 + i, t, "en") for i, t in enumerate(["cat the on", "zebra?!", prose(r), "x", "Anna sat.\nAnna sat."])]
    docs = spark.createDataFrame(trusted + others, "doc_id int, text string, lang string")
    got = {x.doc_id: x.perplexity for x in quality.classify(docs, docs.filter("doc_id < 100")).collect()}
    model = Plain([t for _, t, _ in trusted])
    for i, t, _ in others:
        assert got[i] == pytest.approx(model.perplexity(t), rel=1e-5)


def test_probabilities_of_a_context_sum_to_one():
    r = random.Random(3)
    model = Plain([prose(r) for _ in range(20)])
    letters = [g[0] for g in model.levels[-1][1]]
    for context in ((None,) * 4, tuple("the "), tuple("qqqq")):
        assert sum(model.p((*context, x)) for x in [*letters, "unseen"]) == pytest.approx(1)


def test_toxic_labels_of_any_language(spark):
    """Toxic words that look like the language's others, never seen in trusted text, are found by their model."""
    r = random.Random(6)
    parts = ["be", "ge", "ver", "ung", "keit", "lich", "ein", "zu"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    text = lambda bad: " ".join("einzuver" + r.choice(parts) if bad and r.random() < 0.05 else word() for _ in range(150))
    rows = [(i, text(False), "de") for i in range(200)] + [(i, text(True), "de") for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    ids = lambda lo, hi: docs.filter(f"doc_id >= {lo} and doc_id < {hi}").select("doc_id")
    kept = {x.doc_id: x.kept for x in quality.classify(docs, ids(0, 150), toxic_ids=ids(200, 230)).collect()}
    assert sum(kept[i] for i in range(230, 260)) <= 3 and sum(kept[i] for i in range(150, 200)) >= 42


def test_ties_long_texts_and_names(spark):
    r = random.Random(8)
    same = prose(r, 60)
    rows = [(i, same, "en", 1, "x") for i in range(20)] + [(50, same, "en", 1, "x"), (51, prose(r, 400_000), "en", 1, "x"), (52, "€" * 3_000_000, None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, trusted int, part string")
    got = {x.doc_id: x for x in quality.classify(docs, docs.filter("doc_id < 20")).collect()}
    assert all(got[i].perplexity == got[i].threshold and got[i].kept for i in range(20))  # as high as the threshold stays
    assert len(got) == 23 and not got[52].kept and got[51].perplexity > 0


def test_steps_and_sends_leave_counts_alone(monkeypatch):
    r = random.Random(4)
    texts = [prose(r) for _ in range(50)]
    want = Counter(tuple(s[i - 4 : i + 1]) for s in map(Plain.padded, texts) for i in range(4, len(s)))
    monkeypatch.setattr(kneser, "HELD", 50)
    parts = ({"a": a, "b": b, "c": np.ones(len(a), np.int64)} for t in texts for _, _, a, b, _ in kneser.text_grams(pa.array([t]), pa.array([3])))
    total = Counter()
    sends = 0
    for batch in kneser.merged(parts, {"c": np.add}):
        sends += 1
        for a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
            assert a >> 42 == 3
            total[tuple(None if x == 1 else chr(x) for x in (a >> 21 & kneser.SYMBOL, a & kneser.SYMBOL, b >> 42, b >> 21 & kneser.SYMBOL, b & kneser.SYMBOL))] += c
    assert total == want and sends > 3
