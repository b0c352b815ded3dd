"""What an article's names and repeated sentences may and may not take away."""

import pytest

from panelforge.llm import html_extract


def texts(*pages):
    return html_extract.induce([html_extract.parse(p) for p in pages])


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<h2 id="discussion">Discussion</h2><p>one</p>', "Discussion one"),
        ('<h2 id="related-work">Related work</h2><p class="notice-period">Notice</p>', "Related work Notice"),
        ('<section class="search-methods"><p>lots</p></section>', "lots"),
        ('<div class="comment-list"><p>gone</p></div><p>kept</p>', "kept"),
        ('<div class="cookie-banner">gone</div><div id="shareButtons">gone</div><p>kept</p>', "kept"),
        ('<div class="ad">gone</div><div class="ad-slot-3">gone</div><div class="adhesion">kept</div>', "kept"),
        ('<p class="ad">gone</p><p class="adhesion" id="ad">kept</p>', "kept"),
    ],
)
def test_names(inner, want):
    assert texts(f"<html><body><nav>menu</nav><article><h1>T</h1>{inner}</article></body></html>") == [f"T {want}"]


def test_a_sentence_that_all_pages_share_stays_and_a_box_goes():
    page = lambda i: f"<html><body><div><a>Home</a></div><article><h1>Title {i}</h1><p>Yes.</p><p>Text {i} of its own.</p><div><span>Join our list</span></div></article></body></html>"
    assert texts(*map(page, range(8))) == [f"Title {i} Yes. Text {i} of its own." for i in range(8)]
