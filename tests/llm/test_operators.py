"""Behaviour that the digest queries don't show: repeated and null ids, clashing columns, other parameters."""

import random

import numpy as np

from quandrel.llm import arrays, components, decontaminate, jaccard, line_dedup, url_filter, vectors

LONG = "A line that is long enough to count as a key here"


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(1, LONG, 0), (1, LONG + "\nown", 1), (2, LONG, 2), (None, LONG, 3), (3, "x\n" + LONG, 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_lines int")
    got = {r.text: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, 40, 3).collect() if r.doc_id is not None}
    assert got == {LONG: got[LONG], LONG + "\nown": ("own", 2, 1), "x\n" + LONG: ("x\n" + LONG, 2, 0)}
    assert [r.kept_text for r in line_dedup.dedup_lines(docs, 40, 3).collect() if r.doc_id is None] == [LONG]
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(docs, 40, 4).collect())  # three documents, five rows


def brute_groups(texts, k, t):
    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())

    sets, root = [shingles(x) for x in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_chains_and_groups_equal_brute_force(spark):
    r = random.Random(3)
    passage = [f"p{i}" for i in range(50)]
    texts = []
    for g in range(12):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.randint(5, 160))] + (passage if g % 3 == 0 else [])
        for _ in range(r.randint(1, 14)):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = f"n{r.randrange(10**6)}"
    texts += [" ".join(passage + [f"t{i}{j}" for j in range(r.randint(0, 6))]) for i in range(30)] + ["", None, "one", "ONE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, t in ((4, 85), (5, 80), (2, 50)):
        got = {x.doc_id: x.component_id for x in jaccard.jaccard_groups(docs, k, t, 100).collect()}
        assert [got[i] for i in range(len(texts))] == brute_groups(texts, k, t)


def test_keep_one_keeps_blanks_and_one_of_repeats(spark):
    a = "one two three four five six seven"
    rows = [(5, a, "c"), (2, a, "c"), (2, a, "c"), (9, " ", "c"), (9, None, "c"), (7, "other words in this one here", "c")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_shingles string")
    kept = sorted((x.doc_id, x.text or "") for x in jaccard.keep_one(docs).collect())
    assert kept == [(2, a), (7, rows[5][1]), (9, ""), (9, " ")]
    assert jaccard.keep_one(docs).columns == docs.columns


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 302), (7, None)]
    r.shuffle(edges)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, **{i: 300 for i in (300, 301, 302)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_by_both_joins(spark, monkeypatch):
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words)), (1, "w3 w4"), (None, " ".join(words[:12])), (2, "W0-w1,w2 w3 w4 w5 w6 w7 w8 w9 tail"), (3, "")]
    docs = spark.createDataFrame([(*x, "mine") for x in rows], "doc_id int, text string, word string")
    items = spark.createDataFrame([("b", " ".join(words[:11])), ("a", " ".join(words[:11])), ("c", "w3 w4"), (None, "tail")], "item_id string, text string")
    want = [(None, 12, 11, ["a", "b", "c"]), (1, 2, 2, ["c"]), (1, 30, 11, ["a", "b", "c"]), (2, 11, 10, ["a", "b", "c"]), (3, 0, 0, [])]
    for limit in (200_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        got = decontaminate.decontaminate(docs, items).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x.item_ids)) for x in got), key=repr) == sorted(want, key=repr)
        assert all(x.word == "mine" for x in got)


def test_templates_are_rejected_by_their_labels(spark):
    urls = [f"http://h.org/{s}/{i}" for s in ("good", "bad") for i in range(200)] + [f"http://h.org/{s}/x" for s in ("u1", "u2")]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, template string")
    labels = spark.createDataFrame([("h.org", f"/{s}/{i}", s == "good") for s in ("good", "bad") for i in range(50)], "host string, path string, good boolean")
    got = {x.url: x for x in url_filter.filter_urls(pages, rules=(), labels=labels).collect()}
    assert got["http://h.org/good/150"].verdict == "allow" and got["http://h.org/bad/150"].verdict == "block"
    assert got["http://h.org/good/150"].template == "/good/{n}"


def test_recall_of_collision_counting(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 32))
    x = np.concatenate([base, base + rng.standard_normal((150, 32)) * rng.uniform(0.1, 0.5, (150, 1))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & ~np.eye(300, dtype=bool)
    docs = spark.createDataFrame([(i, [float(v) for v in e], 1) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for block in (1024, 16):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {r.vec_id: r.n_links for r in vectors.near_vectors(docs).collect()}
        assert sum(got.values()) >= 0.99 * near.sum() > 50 and all(got[i] <= near[i].sum() for i in range(300))
    assert vectors.needed_collisions() >= 10


def test_word_hashes_ignore_place():
    import pyarrow as pa

    data, offsets = arrays.texts(pa.array(["ab cd", None, "", "x ab\tcd  "]).slice(0))
    start, end, row = arrays.word_bounds(data, offsets)
    h = arrays.span_hash(arrays.prefix_hash(data), start, end)
    assert row.tolist() == [0, 0, 3, 3, 3] and h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert list(arrays.steps(np.array([0, 5, 5, 5, 20]), 6)) == [(0, 3), (3, 4)]
