"""Attributes, heads and bodies of pages."""

import pytest

from skyloom.llm import html

SAID = "Words of a page that say a lot, with commas, and go on for a while."


@pytest.mark.parametrize(
    "page",
    [
        f'<article><p><a href="/hidden-gems">{SAID}</a> {SAID}</p></article>',
        f"<article><p><a href=/x?hidden>{SAID}</a> {SAID}</p></article>",
        f'<article><p title="The hidden cost">{SAID} {SAID}</p></article>',
        f'<article><p data-hidden="false" data-style="display:none">{SAID} {SAID}</p></article>',
        f'<article><p data-x="?id=nav&amp;class=ad">{SAID} {SAID}</p></article>',
        f"<html><head><meta charset=utf-8><title>T</title><body><article><p>{SAID} {SAID}</p></article>",
        f"<html><head><title>T</title><article><p>{SAID} {SAID}</p></article>",
        f"<head><title>T<body><article><p>{SAID} {SAID}</p></article>",
        f'<html class="no-sidebar"><body class="has-sidebar" id="menu"><article><p>{SAID} {SAID}</p></article></body></html>',
        f"<article><p>{SAID} {SAID}</p><p hidden>no</p><p style='color:red; display: none'>no</p><p aria-hidden=true>no</p><p class=x hidden=''>no</p></article>",
    ],
)
def test_content_stays(page):
    assert html.main_text(page, html.trained_weights()) == f"{SAID} {SAID}"


def test_values_are_no_names():
    for raw, bad in (("<a href='?id=nav'>", False), ("<div data-id=nav>", False), ("<div id = nav>", True), ('<div class="x ad">', True)):
        assert html._element(raw[1:].split()[0], raw, 1).bad == bad


def test_text_ends_a_head_and_its_elements_do_not():
    blocks = html.blocks_of("<head><title>T</title><noscript><img src=x></noscript><template><p>no</p></template>shown<p>too</p>")
    assert [b.text for b in blocks] == ["shown", "too"]
