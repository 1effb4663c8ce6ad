"""Columns of any name pass through the URL filter."""

from quandrel.llm import url_filter


def test_dots_and_clashing_names(spark):
    names = ["a.b", "shape", "page", "fits", "segs", "of_host", "n"]
    pages = spark.createDataFrame([(i, f"http://example.com/en/{i}", *names) for i in range(3)], "page_id int, url string, " + ", ".join(f"`{n}` string" for n in names))
    got = url_filter.filter_urls(pages)
    assert got.columns[: len(pages.columns)] == pages.columns
    assert {(r.verdict, *(r[n] for n in names)) for r in got.collect()} == {("block", *names)}
