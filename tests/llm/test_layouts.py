"""Main text of hand-made pages in the layouts that sites use, with the text to expect."""

import pytest

from panelwise.llm import html

A = "The first paragraph of the story tells in more than twelve words what has happened in the town."
B = "A second paragraph goes on with it and says who was there, and why they had come from afar."
C = "The third one ends the story with what the mayor said to the people on the square that day."
JUNK = "This is a long paragraph of something else that is not of the story but has all the words it needs."
STORY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"{A}\n{B}\n{C}"
MENU = '<div class="nav"><a href="/">Home</a> <a href="/a">About</a></div>'

PAGES = {
    "plain paragraphs": (f"<html><body>{STORY}</body></html>", TEXT),
    "article": (f"<nav>{JUNK}</nav><article>{STORY}</article><footer>{JUNK}</footer>", TEXT),
    "main": (f"<header><p>{JUNK}</p></header><main>{STORY}</main><aside><p>{JUNK}</p></aside>", TEXT),
    "article role": (f'<div role="navigation"><p>{JUNK}</p></div><div role="article">{STORY}</div>', TEXT),
    "entry content": (f'<div class="entry-content">{STORY}</div><div class="widget-area"><p>{JUNK}</p></div>', TEXT),
    "layout with a sidebar": (f'<div class="layout has-sidebar">{STORY}<div class="sidebar"><p>{JUNK}</p></div></div>', TEXT),
    "post without comments": (f'<div class="post no-comments">{STORY}</div>', TEXT),
    "sections of an article": (f'<article><section id="legal-background"><p>{A}</p></section><section id="feedback-loops"><p>{B}</p></section></article>', f"{A}\n{B}"),
    "page-wide form": (f'<form id="aspnetForm">{MENU}{STORY}<div class="site-footer"><p>{JUNK}</p></div></form>', TEXT),
    "form around an article": (f'<form><article>{STORY}</article><div class="newsletter-signup"><p>{JUNK}</p></div></form>', TEXT),
    "form beside a story": (f"<div>{STORY}</div><form><p>{JUNK}</p><input></form>", TEXT),
    "form in a story": (f"<article><p>{A}</p><form><label>Your mail</label><p>{JUNK}</p></form><p>{B}</p></article>", f"{A}\n{B}"),
    "hidden in a value": (f'<article data-title="the hidden cost of">{STORY}</article>', TEXT),
    "hidden in a title": (f'<div title="a hidden gem"><p>{A}</p></div>', A),
    "hidden element": (f"<div><p>{A}</p><p hidden>{JUNK}</p><p HIDDEN='x'>{JUNK}</p><p>{B}</p></div>", f"{A}\n{B}"),
    "hidden by style": (f'<article><p>{A}</p><div style="color:red; display: none"><p>{JUNK}</p></div></article>', A),
    "hidden from readers": (f'<article><p>{A}</p><div aria-hidden="true"><p>{JUNK}</p></div></article>', A),
    "teaser articles": (f'<div id="story">{STORY}</div><article class="teaser"><p>{JUNK}</p></article><article class="teaser"><p>{JUNK}</p></article>', TEXT),
    "cards beside a story": (f"<div>{STORY}</div><article><h3>Other</h3><p>{JUNK}</p></article><article><p>{JUNK}</p></article>", TEXT),
    "related cards in a box": (f'<article>{STORY}</article><div class="related-posts"><article><p>{JUNK}</p></article></div>', TEXT),
    "button in a sentence": ("<article><p>Press <button>Go</button> and the rest of the sentence stays in one block with the words before it.</p></article>", "Press and the rest of the sentence stays in one block with the words before it."),
    "icon in a sentence": ("<article><p>Water <svg><path/><text>x</text></svg> boils at the point that the table on the right gives for it.</p></article>", "Water boils at the point that the table on the right gives for it."),
    "badge in a sentence": ('<article><p>The list <span class="ad">Ad</span> of the things that were in the box is on the next page of the book.</p></article>', "The list of the things that were in the box is on the next page of the book."),
    "block in a button": (f"<article><p>{A}</p><button><div>Read more</div></button><p>{B}</p></article>", f"{A}\n{B}"),
    "comments": (f'<article>{STORY}</article><section id="comments"><h2>Comments</h2><div class="comment-body"><p>{JUNK}</p></div></section>', TEXT),
    "many comments": (f'<div>{STORY}</div><div class="comment-list">' + f"<p>{JUNK}</p>" * 9 + "</div>", TEXT),
    "comments as articles": (f'<main>{STORY}<article class="comment"><p>{JUNK}</p></article></main>', TEXT),
    "nothing but comments": (f'<div class="comments"><p>{JUNK}</p></div>', ""),
    "cookie wall": (f'<div class="cookie-banner"><p>{JUNK}</p><button>Accept</button></div><div>{STORY}</div>', TEXT),
    "popup that holds the page": (f'<div class="overlay"><div class="modal">{STORY}</div></div>', TEXT),
    "adverts between paragraphs": (f'<article><p>{A}</p><div class="ad-container"><p>{JUNK}</p></div><p>{B}</p></article>', f"{A}\n{B}"),
    "share buttons": (f'<article><p>{A}</p><ul class="share-buttons"><li>Mail it to all the people that you know and to all the others</li></ul></article>', A),
    "links": (f'<div>{STORY}<ul><li><a href="a">One of the other stories of the day that we have for you</a></li></ul></div>', TEXT),
    "headline and short lines": (f"<article><h1>Town news</h1><p>{A}</p><p>So it was.</p><p>{B}</p></article>", f"Town news\n{A}\nSo it was.\n{B}"),
    "table layout": (f'<table><tr><td class="menu">{MENU}</td><td>{STORY}</td></tr></table>', TEXT),
    "breaks": (f"<article>{A}<br>{B}</article>", f"{A} {B}"),
    "references": ("<article><p>Fish &amp; chips &lt;cheap&gt; were to be had at the caf&eacute; on the corner for 5&nbsp;pounds.</p></article>", "Fish & chips <cheap> were to be had at the café on the corner for 5 pounds."),
    "unclosed": (f"<article><p>{A}<p>{B}<div class=ad>{JUNK}</div></article><p>{JUNK}", f"{A}\n{B}"),
    "hidden script text": (f"<article><script>if (a<b) document.write('<p>{JUNK}</p>')</script>{STORY}</article>", TEXT),
    "empty": ("", ""),
    "menus only": (f"<nav>{JUNK}</nav>{MENU}", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layout(name):
    page, want = PAGES[name]
    assert html.main_text(page) == want
    wrapped = f"<!DOCTYPE html><html><head><title>{JUNK}</title></head><body>{page}</body></html>"
    assert html.main_text(wrapped) == want


def test_names_made_of_unwanted_words_alone():
    for name in ("sidebar", "site-footer", "comment-list", "related-posts", "cookie-banner", "ad", "left-sidebar", "share-buttons", "nav_menu"):
        assert html.unwanted_words(name), name
    for name in ("has-sidebar", "no-comments", "legal-background", "feedback-loops", "post", "main-content", "adventure", "header-image-of-town"):
        assert not html.unwanted_words(name), name


def test_nested_containers_take_linear_time():
    import time

    for piece in ("<form>", "<div class=ad>", "<article>", f"<div class=widget><p>{JUNK}</p>", "<svg>", "<span hidden>x", "<button>a<div>b"):
        begun = time.perf_counter()
        html.main_text(piece * 20_000 + STORY)
        assert time.perf_counter() - begun < 10
