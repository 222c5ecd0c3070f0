"""What the inferred wrapper of a host decides: pages with and without article, notices and comments under neutral names."""

import random
from collections import Counter

import pytest

from quaver.llm import html_wrappers as hw

r = random.Random(21)


def words(n):
    return " ".join("".join(r.choice("abcdefghiklmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(n)) + "."


def make(spark, pages):
    return spark.createDataFrame([(i, "https://h.example/" + str(i), p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string")


def article(i, shared=""):
    paragraphs = [words(40) for _ in range(r.randrange(2, 6))]
    title = words(5)
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    line = f"<p>{shared}</p>" if shared else ""
    page = f"""<html><body><nav><a href="/">Start</a></nav><article><h1>{title}</h1><div class="x1">Read this in our app, it is free.</div>{body}{line}<div class="x2">Was this of use? <a href="/y">yes</a> no</div></article><footer>end</footer></body></html>"""
    return page, "\n\n".join([title, *paragraphs, *[shared] * bool(shared)])


def neutral(i):
    """No article, no telling names: notice and rail are the same on all pages, the story is under a name that usually drops a block."""
    paragraphs = [words(60) for _ in range(r.randrange(2, 5))]
    page = f"""<html><body><div class="a1"><a href="/">Start</a> <a href="/n">News</a></div><div class="a2">We use small files to keep you signed in.</div><div class="widget-9"><h2>{words(4)}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div class="a5">Do write to us about this piece.</div></div><div class="a3">All rights are ours since 1999.</div></body></html>"""
    title = page.split("<h2>")[1].split("</h2>")[0]
    return page, "\n\n".join([title, *paragraphs])


@pytest.mark.parametrize("kind", [article, neutral])
def test_a_hosts_fixed_texts_drop_out_under_any_name(spark, kind):
    pages = [kind(i) for i in range(12)]
    got = {x.page_id: x.text for x in hw.extract(make(spark, pages)).collect()}
    assert got == {i: text for i, (_, text) in enumerate(pages)}


@pytest.mark.parametrize("kind", [article, neutral])
def test_the_wrapper_decides(kind):
    """A page matched with a wrapper of its own keeps what the other pages tell to be fixed."""
    pages = [kind(i) for i in range(12)]
    wrapper = None
    for p, _ in pages:
        items = hw.folded(hw.copied(hw.parse(p)[0]))
        wrapper = items if wrapper is None else hw.aligned(wrapper, items)
    named = Counter(n for p, _ in pages for n in {n for n, _ in hw.places_of(hw.parse(p)[0])})
    whole = hw.Extractor(wrapper, set(), {n for n, c in named.items() if c > 6}, len(pages))
    for p, text in pages:
        assert hw.main_text(p, whole) == text != hw.main_text(p, None)


def test_a_line_that_many_articles_share_stays(spark):
    line = "The same licence holds for all of this text, whoever wrote it."
    pages = [article(i, line if i % 5 else "") for i in range(15)]
    got = {x.page_id: x.text for x in hw.extract(make(spark, pages)).collect()}
    assert got == {i: text for i, (_, text) in enumerate(pages)}


def test_copies_and_few_pages_lose_nothing(spark):
    page, _ = article(0)
    own = hw.main_text(page, None)
    got = hw.extract(make(spark, [(page, "")] * 9)).collect()
    assert {x.text for x in got} == {own}
    pages = [article(i) for i in range(9)] + [(page.replace("<h1>", "<aside>x</aside><section>Only here.</section><h1>"), "")] * 7
    got = hw.extract(make(spark, pages)).where("page_id = 12").first().text
    assert got.startswith("Only here.") and "our app" not in got
    pages = [article(i) for i in range(hw.LEAST_PAGES - 1)]
    got = {x.page_id: x.text for x in hw.extract(make(spark, pages)).collect()}
    assert got == {i: hw.main_text(p, None) for i, (p, _) in enumerate(pages)}


def test_repeats_within_a_page_are_no_template(spark):
    """A quotation that one page repeats is on one page only."""
    pages = [article(i) for i in range(10)]
    page, text = pages[3]
    quote = "<blockquote>Say it again and again.</blockquote>"
    pages[3] = (page.replace("</h1>", "</h1>" + (quote + "<hr>") * 8, 1), text.replace("\n\n", "\n\n" + "Say it again and again.\n\n" * 8, 1))
    got = {x.page_id: x.text for x in hw.extract(make(spark, pages)).collect()}
    assert got == {i: text for i, (_, text) in enumerate(pages)}
