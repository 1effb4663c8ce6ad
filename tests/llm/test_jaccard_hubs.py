import random

import pytest

from quandrel.llm import jaccard
from quandrel.llm.components import components
from tests.llm.test_operators import brute_groups


def test_a_large_group_about_the_threshold(spark):
    """A large group of near copies, some linked and some not, and a passage with little besides it equal brute force."""
    r = random.Random(9)
    word = lambda: "w%d" % r.randrange(10**6)
    base = [word() for _ in range(60)]
    texts = [" ".join(word() if r.random() < 0.035 else w for w in base) for _ in range(120)] + [" ".join(word() for _ in range(60)) for _ in range(20)]
    texts += [" ".join([*base, *(word() for _ in range(4 + i % 20))]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = brute_groups(texts, 5, 80)
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 1 < len(set(want[:120])) < 120


def test_clashing_names_pass_through_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 7, 1), (2, "a b c d e f", "y", 8, 2)], "doc_id int, text string, _th string, _id int, blank int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and [tuple(x) for x in kept.collect()] == [(1, "a b c d e f", "x", 7, 1)]


@pytest.mark.parametrize("apart", [False, True])
def test_components_are_found_once_where_no_two_meet(spark, monkeypatch, apart):
    """Each search for components is some thirty jobs, whose plans fill the driver."""
    calls = []
    monkeypatch.setattr(jaccard, "components", lambda edges: calls.append(1) or components(edges))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], "x", *words[i + 1 :]]) for i in (58, 59)] + [" ".join(words)] * 2
    texts += [" ".join([*words[:12], *(f"{k}v{i}" for i in range(40))]) for k in range(3)] if apart else []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, 5, 80, 100).collect()}
    assert got == {i: 0 if i < 4 else i for i in range(len(texts))} and len(calls) == 1
