import time

import pytest

from quandrel.llm.html_text import main_text

LONG = "It was the best of the times and it was the worst of the times, as they said in the book that we have read."
RU = "Это было лучшее из времён и это было худшее из времён, как говорили в той книге, которую мы все читали когда-то."


@pytest.mark.parametrize("name", ["share-text", "search-result-highlight", "form-fields-intro", "alert-history-text"])
def test_text_of_an_article_survives_a_name_that_mentions_a_mark(name):
    assert main_text(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG} Again.</p></div></article>") == f"{LONG}\n\n{LONG} Again."


@pytest.mark.parametrize("name", ["site-footer", "share-buttons", "related-posts", "cookie-notice", "main-nav", "comment-list", "sidebar"])
def test_parts_of_an_article_that_are_no_text_go(name):
    assert main_text(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG} Again.</p></div></article>") == LONG


def test_named_paragraphs():
    assert main_text(f"<article><p>{LONG}</p><p class='advert'>{LONG} Buy.</p><p class='lead'>So.</p></article>") == f"{LONG}\n\nSo."


def test_wrappers_of_two_names():
    assert main_text(f'<div class="layout no-sidebar"><h1>T</h1><p>{LONG}</p></div>') == f"T\n\n{LONG}"
    assert main_text(f'<div id="page" class="has-sidebar"><article><p>{LONG}</p></article></div>') == LONG


def test_stray_quotes_and_broken_attributes():
    page = f"""<article><p title="5" tall">{LONG}</p><p class=a"b>One</p><p data-x='>'>Two</p><p title="never closed>Three</p></article>"""
    assert main_text(page) == f"{LONG}\n\nOne\n\nTwo\n\nThree"


def test_lists_of_links_in_an_article_go_and_lists_of_text_stay():
    links = "".join(f"<li><a href=/{i}>See part {i}</a></li>" for i in range(5))
    text = "".join(f"<li>Point {i} of the list</li>" for i in range(3))
    assert main_text(f"<article><p>{LONG}</p><ul>{links}</ul><ul>{text}</ul><p><a href=x>One link</a></p></article>") == "\n\n".join([LONG, *(f"Point {i} of the list" for i in range(3)), "One link"])


def test_a_language_without_known_stop_words():
    links = "".join(f"<li><a href=/{i}>Раздел номер {i}</a></li>" for i in range(9))
    assert main_text(f"<ul>{links}</ul><div><h1>Начало</h1><p>{RU}</p><p>Да.</p><p>{RU}</p></div><div><a href=/>Карта</a></div>") == f"Начало\n\n{RU}\n\nДа.\n\n{RU}"


def test_unclosed_buttons_and_options_lose_nothing():
    assert main_text(f"<article><option>x<button>y<p>{LONG}</p></article>") == f"x y\n\n{LONG}".replace("x y", "xy")


def test_time_is_linear():
    def seconds(n):
        page = "<div>" + "".join(f"<p>a{i} b</p><option>" for i in range(n)) + "</div>"
        t = time.process_time()
        main_text(page)
        return time.process_time() - t

    seconds(1000)
    assert seconds(32_000) < 24 * max(0.02, seconds(4_000))


def test_very_long_page():
    assert len(main_text(f"<article>{'<p>' + LONG + '</p>'}" * 20_000)) == 20_000 * (len(LONG) + 2) - 2
