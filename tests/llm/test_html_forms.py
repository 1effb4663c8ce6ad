"""Forms that frame a page keep its article; forms inside it go; dialogs and reader reviews go."""

import time

import pytest

from quandrel.llm.html_text import main_text

LONG = "It was the best of the times and it was the worst of the times, as they said in the book that we have read."
FORM = f"<form><label>Your name and the mail that we have of you, as it was</label><input><p>{LONG} Sign.</p></form>"


@pytest.mark.parametrize("page", ["<body><form id='aspnetForm'><main><article>{}</article></main></form>", "<form class='form'><article>{}</article></form>", "<form><div><nav>a b</nav><article>{}</article></div>", "<form id=f>" + "<div>{}</div>" + "</form>"])
def test_a_form_about_the_page_keeps_its_text(page):
    text = "".join(f"<p>{LONG} {i}</p>" for i in range(4))
    assert main_text(page.format(text)) == "\n\n".join(f"{LONG} {i}" for i in range(4))


def test_forms_inside_go():
    assert main_text(f"<article><p>{LONG}</p>{FORM}</article>") == LONG
    assert main_text(f"<form><article><p>{LONG}</p></article></form>{FORM}") == LONG
    assert main_text(f"{FORM}<div><p>{LONG} 1</p><p>{LONG} 2</p></div>") == f"{LONG} 1\n\n{LONG} 2"


@pytest.mark.parametrize("part", ["class='user-reviews'", "role='dialog'", "id=reviews"])
def test_reviews_and_dialogs_go(part):
    assert main_text(f"<article><p>{LONG}</p><div {part}><p>{LONG} Again.</p></div></article>") == LONG


def test_many_forms_take_linear_time():
    took = []
    for n in (2_000, 20_000):
        began = time.perf_counter()
        main_text("<form><p>x" * n + "</form>")
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 0.01)
