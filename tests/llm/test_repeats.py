import hashlib
import random
from collections import defaultdict

import pytest

from quandrel.llm import repeats


def brute(rows, length, keep):
    starts = defaultdict(list)
    raws = [(t or "").encode() for _, t in rows]
    for k, (doc, _) in enumerate(rows):
        for p in range(len(raws[k]) - length + 1):
            starts[raws[k][p : p + length]].append((doc, k, p))
    out = []
    for k, (doc, _) in enumerate(rows):
        gone = bytearray(len(raws[k]))
        for p in range(len(raws[k]) - length + 1):
            at = starts[raws[k][p : p + length]]
            if len(at) > 1 and (keep == "none" or min(at) != (doc, k, p)):
                gone[p : p + length] = b"\x01" * length
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(gone), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raws[k], gone) if not g)).hexdigest()))
    return sorted(out)


def sample(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(20, 60)) for _ in range(4)]
    rows = []
    for _ in range(60):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            parts += [r.choice(passages), text(r.randint(0, 20))]
        rows.append(" ".join(parts))
    rows += [rows[0], rows[1][:150], "x" * 700, "y" * 150, "ab" * 300, "", None]
    near = rows[5] + text(80)
    rows += [near[:i] + "#" + near[i + 1 :] for i in (10, 100, 205, 300)]
    return list(enumerate(rows))


@pytest.mark.parametrize("most", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    rows = sample(most)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("none", "first"):
        got = repeats.remove_repeats(docs, 120, keep).collect()
        assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got) == brute(rows, 120, keep)


def test_empty_table_null_ids_and_extra_columns(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "z" * 300, 1, "k"), (None, "q", 2, "k"), (4, None, 3, None)], "doc_id long, text string, n_removed int, spans string")
    got = {(x.doc_id, x.n_bytes, x.n_removed) for x in repeats.remove_repeats(docs).collect()}
    assert got == {(None, 300, 300), (None, 1, 0), (4, 0, 0)}
