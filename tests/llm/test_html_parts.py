"""Parts of a page told by words of classes, by density where these leave doubt, and by articles."""

import time

import pytest

from lamina.llm import html

TEXT = [f"Sentence {i} of the article says something that readers came for." for i in range(13)]
BODY = "".join(f"<p>{x}</p>" for x in TEXT)
LONG = "A reader wrote a whole sentence here, quite as long as those of the article."
PARTS = "reader-comments user-comments user-comment comment-thread comment-body comment-content discussion ad-slot ad-unit ad-label advert-text sponsor-message left-sidebar sidebar-right privacy-notice related-stories".split()


@pytest.mark.parametrize("name", PARTS)
def test_parts_of_compound_classes(name):
    for page in (f"<article>{BODY}<div class={name}><p>{LONG}</p></div></article>", f"<article><div class={name}><p>{LONG}</p></div>{BODY}</article>", f"<div class=content>{BODY}<div id={name}>{LONG}</div></div>"):
        assert html.main_text(page).split("\n") == TEXT


def test_density_decides_in_doubt():
    links = "<ul>" + "<li><a href=x>Another long headline of this site to click on now</a></li>" * 5 + "</ul>"
    short = "<p>Buy now</p><p>Only 9.99</p>"
    for name in ("story-related-box2x", "partner-promo-zone", "article__newsletter--teaser"):
        for part in (links, short):
            assert html.main_text(f"<article><div class='{name}'>{part}</div>{BODY}</article>").split("\n") == TEXT, name
        assert html.main_text(f"<article><div class='{name}'><p>{LONG}</p></div>{BODY}</article>").split("\n") == [LONG, *TEXT]  # as dense as the rest
        assert html.main_text(f"<body><div class='{name}'>{BODY}</div><p>Short.</p></body>").split("\n")[:13] == TEXT  # holds the text
    assert html.main_text(f"<div class='layout-sidebar-page'><div class='page-comments-open'>{BODY}</div></div>").split("\n") == TEXT


def test_teaser_articles_go_and_parts_of_equal_weight_stay():
    teaser = f"<article class=card><h2>Other</h2><p>{'Read this too. ' * 6}</p></article>"
    for page in (f"<article>{BODY}</article>{teaser}", f"{teaser * 2}<article>{BODY}</article>"):
        assert html.main_text(page).split("\n") == TEXT
    assert html.main_text(f"<article>{BODY}</article><article>{BODY}</article>").split("\n") == TEXT * 2


def test_forms_do_not_part_text_and_a_foot_is_none():
    form = "<form><p>Your name</p><p>Your address</p><button>Send</button></form>"
    assert html.main_text(f"<body><p>Intro.</p>{form * 3}{BODY}</body>").split("\n") == ["Intro.", *TEXT]
    assert html.main_text(f"<div><div>{BODY}</div><div class=foot>Copyright 2024 us</div></div>").split("\n") == TEXT


def test_many_doubts_take_linear_time():
    start = time.time()
    html.main_text("<div class='x-comment-y'>" * 20000 + "<p>word</p>" * 20000)
    html.main_text("<div class='x-comment-y'><p>word</p></div>" * 20000)
    assert time.time() - start < 10
