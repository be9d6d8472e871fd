import html
import re
import time
from collections import Counter

import llm_cases
import pytest

from gridtide.llm import extract, queries

SF = "/root/testdata/sf0.01"


def article(page):
    """Text of the article element of a test page, by its known template."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
    body = re.sub(r"<(p|h1|/p|/h1)>", "\x01", body.replace("<br>", " "))
    body = re.sub(r"<[^>]*>|<[^>]*\Z", "", body)
    blocks = (" ".join(html.unescape(block).split()) for block in body.split("\x01"))
    return "\n".join(block for block in blocks if block)


def test_best_region_equals_all_regions():
    import random

    draw = random.Random(3)
    for _ in range(300):
        scores = [draw.randint(-5, 5) for _ in range(draw.randint(0, 12))]
        start, end = extract.best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[start:end]) == max([0, *sums])


def test_elements_that_are_no_content():
    page = (
        "<html><head><title>T</title></head><body><header>Top</header><div class='cookie-notice'>We use cookies</div>"
        "<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>&nbsp;text<br>goes on<p>Second\n  one<script>var x='<p>no</p>'</script>"
        "<form>Sign up</form><aside>Aside</aside><div class=ad>Buy now</div><p>Third</article>"
        "<section id=comments><p>Nice post</p></section><footer>Foot</footer></body></html>"
    )
    counts = Counter()
    for _ in range(3):
        counts.update(extract.type_counts(page))
    text = extract.extract(page, extract.learn_weights(counts))
    assert text == "Title & more\nFirst bold text goes on\nSecond one\nThird"


def test_headers_and_notices_of_an_article_stay():
    page = (
        '<body><div class="header">Site</div><div class="notice">We moved</div><article><div class="header"><h1>Title of it</h1></div><p>One two three four.</p>'
        '<p class="notice">Last words here.</p><div class="comments">Nice</div></article><div class="footer">Foot</div></body>'
    )
    weights = extract.learn_weights(extract.type_counts(page))
    assert extract.extract(page, weights) == "Title of it\nOne two three four.\nLast words here."


@pytest.mark.parametrize(
    "page",
    ["<div>" * 90_000 + "</p>" * 90_000, "<b>" * 150_000 + "<hr>" * 120_000, "<p><div>" * 60_000 + "<b>" * 60_000 + "<hr>" * 60_000, "<p><b>" * 150_000,
     "<li><p>" * 150_000, "<table><tr><td>" * 60_000, "</div>" * 170_000, "<a href='" * 110_000, '<script "' * 110_000, "<script>" * 130_000, "<!--" * 260_000, "<p class=" * 110_000,
     "&amp" * 260_000, "<" * 1_000_000, "<div class='ad'>" * 65_000 + "x", "word " * 200_000],
)
def test_a_megabyte_of_one_tag_takes_linear_time(page):
    start = time.process_time()
    extract.extract(page, {})
    assert time.process_time() - start < 5


def test_odd_markup_never_fails():
    for page in ("", "plain words", "<", "<p", "</p></p>", "<p>a<p>b", "<script>x", "<a href='x>y", "<!-- open", "a < b > c", "<P CLASS=\"x\">Q</P>", "&#0;&bogus;&amp", "<div " * 50):
        assert isinstance(extract.extract(page, {}), str)
    assert extract.extract("<p>a b<p>c d", {}).startswith("a b")


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>word " * 2000), (None, "u", "<p>x</p>"), (3, "u", "<p>same</p>"), (3, "u", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = extract.main_text(pages, extract.fit_weights(pages)).collect()
    assert len(found) == 6 and all(row.text == "" and row.n_chars == 0 for row in found if row.page_id in (1, 2))
    assert extract.main_text(pages.limit(0), extract.fit_weights(pages.limit(0))).count() == 0


def test_query_finds_the_article_of_every_page(spark):
    pages = dict(llm_cases.read(SF, "SELECT page_id, html FROM pages"))
    rows = queries.QUERIES["op7_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for row in rows:
        assert row.text == article(pages[row.page_id]) and row.n_chars == len(row.text)


def test_a_long_nav_inside_an_article_does_not_split_it():
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(40))
    page = (
        f"<html><body><div><ul>{links}</ul></div><article><h1>A headline</h1><p>Before the block.</p>"
        f"<nav><ul>{links}</ul></nav><div class=share>{'<a href=x>Share</a>' * 20}</div><p>After the block.</p></article>"
        "<div class=teasers>More pages</div></body></html>"
    )
    counts = Counter()
    for _ in range(100):
        counts.update(extract.type_counts(page))
    assert extract.extract(page, extract.learn_weights(counts)) == "A headline\nBefore the block.\nAfter the block."
