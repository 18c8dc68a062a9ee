"""What markup may and may not remove; the LCS on long and repetitive pages."""

import random
import time

import pytest

from webloom.llm import html_text


def kept(page):
    return [t for t, zone in html_text.page_lines(page) if zone != html_text.CHROME]


@pytest.mark.parametrize("page", [
    '<article class="commentary"><p>text</p></article>',
    '<article class="comment"><p>text</p></article>',
    '<div class="content no-sidebar"><p>text</p></div>',
    '<div class="has-sidebar content"><p>text</p></div>',
    '<article><p class="related-work">text</p></article>',
    '<article><section id="search"><p>text</p></section></article>',
    '<article><div class="navigation-systems"><p>text</p></div></article>',
    '<main><div class="post category-sponsored-form"><p>text</p></div></main>',
    '<div data-x=\'class="ad"\'><p>text</p></div>',
    '<div title="a class=ad of its own" data-class=ad><p>text</p></div>',
    '<div class="headerless adverse shared-memory formula"><p>text</p></div>',
    '<div id="socialism"><p>text</p></div>',
])
def test_text_stays(page):
    assert kept(page) == ["text"]


@pytest.mark.parametrize("name", ["ad", "ads", "top-ad", "ad-slot-3", "cookie-notice", "sidebar", "sidebar-left", "rightSidebar", "user-comments", "commentlist", "related-posts", "site-footer",
                                  "main-nav", "newsletter-signup", "share-buttons", "social", "x sidebar y", "advert", "advertisement", "comment-list", "breadcrumbs", "cookie-banner", "notice"])
def test_chrome_goes(name):
    assert kept(f'<div class="{name}"><p>chrome</p></div><p>text</p>') == ["text"]
    assert kept(f"<article><p>text</p><div data-a=\"x'y\" CLASS='{name}'><p>chrome</p></div></article>") == ["text"]


def test_comments_as_articles_go_where_there_is_a_story():
    assert kept('<article><p>text</p></article><ol class="comments"><li><article class="comment"><p>me too</p></article></li></ol>') == ["text"]
    assert kept('<main><p>text</p><article id="comment-5" class="comment-body"><p>me too</p></article></main>') == ["text"]


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(40))] for _ in range(2))
        places = sorted(html_text.shared_lines(a, b))
        assert len(places) == longest(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in places)


def test_long_repetitive_pages_take_little_time():
    rng = random.Random(3)
    began = time.process_time()
    assert len(html_text.shared_lines([7] * 10_000, [7] * 9_000 + [8])) == 9_000
    a, b = ([rng.randrange(4) for _ in range(n)] for n in (8_000, 12_000))
    assert len(html_text.shared_lines(a, b)) > 6_000
    assert time.process_time() - began < 3


def test_a_page_of_many_equal_lines(spark):
    long = "<p>same</p>" * 10_000
    pages = [(1, "http://h/1", long + "<p>own one</p>"), (2, "http://h/2", "<p>first</p>" + long), (3, "http://h/3", "<article>" + long + "</article>")]
    got = {r.page_id: r.n_chars for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == 10_000 * 5 - 1 and set(got) == {1, 2, 3}
