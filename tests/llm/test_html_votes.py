"""Layouts that climb, names that stay, and the vote of hosts against plain Python."""

import random
from collections import Counter

import pytest

from siftstone.llm import html_text as h
from tests.llm.test_html_text import FOOT, MENU, own, page

LONG = ("a long quotation that says much more than the article around it " * 6).strip()
P = "Some prose of the article, of a middling length."


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<article><h1>Head</h1><p>{P}</p><blockquote><p>{LONG}</p></blockquote></article>", ["Head", P, LONG]),
        (f"<div class=post><h1>Head</h1><p>{P}</p><details><summary>More</summary><p>{LONG}</p></details></div>", ["Head", P, "More", LONG]),
        (f"<article><h1>Head</h1><section class=one><p>{P}</p></section><section class=two><p>{LONG}</p></section></article>", ["Head", P, LONG]),
        (f"<div class=recipe><h1>Soup</h1><p>{P}</p><ul><li>{LONG}</li><li>{LONG}x</li></ul></div>", ["Soup", P, LONG, LONG + "x"]),
        (f"<div class=post><p>{P}</p><figure><figcaption>{LONG}</figcaption></figure></div><div class=x>other</div>", [P, LONG]),
        (f"<div class=post><div class=text><p>{LONG}</p></div><p>{P}</p></div><div class=x>other</div>", [LONG, P]),
        (f"<table><tr><td>{LONG}</td><td>b</td></tr><tr><td>{P}</td></tr></table>", [LONG + " b", P]),
    ],
)
def test_the_whole_article(body, want):
    assert own(page(f"{MENU}{body}{FOOT}")).split("\n") == [x.strip() for x in want]


def test_names_that_may_stand_in_an_article():
    body = (
        '<div class="share-price"><p>The price of a share rose.</p></div><p class="notice-period">A notice period of a month.</p>'
        '<section class="related"><p>Related work is discussed here at length.</p></section><p>So <math><mi>x</mi>+<mn>1</mn></math> holds.</p>'
        "<p><svg><text>drawn</text></svg> <button>press</button> <span aria-hidden=true>seen</span></p><noscript><p>Without scripts.</p></noscript>"
    )
    want = ["The price of a share rose.", "A notice period of a month.", "Related work is discussed here at length.", "So x+1 holds.", "drawn press seen", "Without scripts."]
    assert own(page(f"{MENU}<article>{body}</article>{FOOT}")).split("\n") == want
    gone = (
        '<div class="related-posts"><a href=/a>One related story</a> <a href=/b>Another</a></div><ul class="share"><li><a href=/s>Share this</a></ul>'
        '<div class="ad-box">Buy.</div><div id="left-sidebar">Side.</div><div class="post-comments">I say.</div><div class="comment-42">No.</div>'
        '<p hidden>Not shown.</p><div role="alert">Beware.</div><article class="comment">A reader.</article><form><button>Send</button></form>'
    )
    assert own(page(f"<article><p>{P}</p>{gone}</article>")) == P


def test_names_of_several_words():
    gone = ("ad", "ad-box", "top-banner", "site-footer", "cookie-notice", "sidebar_left", "user-comments", "main-nav", "adsense1")
    kept = ("share-price", "notice-period", "ad-hoc", "header-less-shape", "no-sidebar", "content", "post", "menu-planning", "comment-culture", "12")
    assert [h.named(x, False) for x in gone] == [h.GONE] * len(gone)
    assert [h.named(x, False) for x in kept] == [h.KEPT] * len(kept)
    assert h.named("article-header", True) == h.KEPT


def brute_votes(rows):
    """The winning path of each host and the text of every page, page by page."""
    host = lambda u: u.split("//")[1].split("/")[0].lower()
    pages = [(i, host(u), h.Page(s)) for i, u, s in rows]
    count = {}
    for _, site, one in pages:
        if one.blocks:
            count.setdefault(site, Counter())[one.containers[one.best()][1]] += 1
    won = {site: min(c, key=lambda p: (-c[p], p)) for site, c in count.items()}
    return won, sorted((i, one.text(won.get(site))) for i, site, one in pages)


def test_hosts_vote_apart(spark):
    """Two hosts choose different containers of the same markup; a tie goes to the smaller path."""
    r, rows = random.Random(4), []
    words = lambda n: " ".join(r.choices("alpha beta gamma delta epsilon".split(), k=n))
    for i in range(60):
        site = ("one.org", "Two.org", "tie.org")[i % 3]
        first, second = (r.randint(5, 9), r.randint(1, 12)) if site == "one.org" else (r.randint(1, 12), r.randint(5, 9))
        if site == "tie.org":
            first, second = (9, 4) if i % 2 else (4, 9)
        rows.append((i, f"http://{site}/{i}", page(f"{MENU}<div class=b><p>{words(first)}</p></div><div class=a><p>{words(second)}</p></div>")))
    won, want = brute_votes(rows)
    assert won["one.org"].endswith("div.b") and won["two.org"].endswith("div.a") and won["tie.org"].endswith("div.a")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["host"]: x["__path"] for x in h.winners(h.votes(df, "url", "html")).collect()}
    assert got == won
    assert sorted((x.page_id, x.text) for x in h.extract(df).collect()) == want
