import pytest

from quandrel.llm.html_text import main_text

LONG = "It was the best of the times and it was the worst of the times, as they said in the book that we have read."
ADVERT = "<div class='sidebar'><p>The best of the offers that you can have for all of the days of the year, and it is for you.</p></div>"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-nav", "search-results", "sidebar", "site hasSidebar"])
def test_wrappers_keep_their_article(name):
    text = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    for tag in ("main", "article"):
        assert main_text(f"<div class='{name}'><{tag}>{text}</{tag}>{ADVERT}</div>") == f"Head\n\n{LONG}\n\n{LONG}"
    assert main_text(f"<div class='{name}'>{text}</div>") == f"Head\n\n{LONG}\n\n{LONG}"


def test_wrapper_between_main_and_article():
    assert main_text(f"<main><div class='content-sidebar-wrap'><article><p>{LONG}</p></article>{ADVERT}</div></main>") == LONG
    assert main_text(f"<main><div class='content-sidebar-wrap'><p>{LONG}</p></div></main>") == LONG


def test_marks_still_count():
    assert main_text(f"<div class='with-nav'><p>{LONG}</p>{ADVERT}<div class='comments'><article><p>{LONG}</p></article></div></div>") == LONG
    assert main_text(f"<main><p>{LONG}</p><div class='share-wrapper'>Tell all of the others</div>{ADVERT}</main>") == LONG
