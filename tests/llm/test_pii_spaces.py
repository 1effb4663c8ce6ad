import re

from quandrel.llm import pii


def run(spark, texts):
    return [r.text for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]


def test_more_persons_than_short_surnames(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be"])
    names = [f"Mr {chr(65 + i % 26)}{'x' * (1 + i // 26)}yz" for i in range(40)]
    got = run(spark, names)
    assert len(set(got)) == 40 and all(re.fullmatch(r"Mr (Ba|Be)(ba|be){2,}", x) for x in got)


def test_more_addresses_than_their_format_has(spark, monkeypatch):
    monkeypatch.setattr(pii, "WIDER", 0)
    old = [f"{i}.1.1.1" for i in range(1, 10)]
    got = run(spark, old)
    assert len(set(got)) == 9 and all(0 < int(o) < 255 for x in got for o in x.split(".")) and any(len(x) > 7 for x in got)
