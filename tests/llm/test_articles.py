"""Importance, inside declared articles and without any."""

from __future__ import annotations


def test_furniture_inside_an_article_is_dropped_and_copies_are_kept(spark):
    from quillon.llm.html import main_text

    box = "<div class=joinus><p>Join our readers today.</p></div>"
    page = lambda k: f"<body><article><h1>Title {k}</h1><p>Story {k} is told here.</p>{box}</article></body>"
    pages = [(k, f"http://one.example/{k}", page(k)) for k in range(6)]
    pages += [(10 + k, f"http://copies.example/{k}", page(0)) for k in range(6)]
    pages += [(20 + k, f"http://few.example/{k % 3}", page(k % 3)) for k in range(6)]
    rows = main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).toPandas().set_index("page_id").text
    story = lambda k: f"Title {k}\nStory {k} is told here."
    assert [rows[k] for k in range(6)] == [story(k) for k in range(6)]
    assert {rows[10 + k] for k in range(6)} == {story(0) + "\nJoin our readers today."}
    assert [rows[20 + k] for k in range(6)] == [story(k % 3) + "\nJoin our readers today." for k in range(6)]


def test_hosts_without_an_article(spark):
    """The tree alone parts what changes from what stays; the declared place and the names are only evidence."""
    from quillon.llm.html import main_text

    words = "red green blue white black grey brown pink gold teal".split()
    page = lambda k: f"<body><div class=x1>Welcome to us</div><div class=x2>{''.join(f'<p>Story {k} part {j} on {words[(k + j) % 10]}.</p>' for j in range(1 + k % 5))}</div><div class=x3>All rights</div></body>"
    pages = [(k, f"http://one.example/{k}", page(k)) for k in range(12)] + [(100 + k, f"http://copies.example/{k}", page(0)) for k in range(6)]
    rows = main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).toPandas().set_index("page_id").text
    for k in range(12):
        assert rows[k] == "\n".join(f"Story {k} part {j} on {words[(k + j) % 10]}." for j in range(1 + k % 5))
    assert {rows[100 + k] for k in range(6)} == {"Welcome to us\nStory 0 part 0 on red.\nAll rights"}


def test_the_tree_outvotes_names(spark):
    """A branch named like furniture stays where its shape and text vary from page to page, and goes where they don't."""
    from quillon.llm.html import main_text

    page = lambda k: f"<body><div class=comments>{'<p>a</p>' * k}<i>{k}</i><b>x</b></div><div class=footer><p>Note {k}</p></div></body>"
    pages = [(k, f"http://one.example/{k}", page(k)) for k in range(1, 61)]
    rows = main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).toPandas().set_index("page_id").text
    assert all(rows[k].startswith("a\n" * k) and "Note" not in rows[k] for k in range(1, 61))


def test_names_that_only_look_like_furniture():
    from quillon.llm.html import extract

    page = '<article><h1>T</h1><p class="form-factor">a</p><p id="notice-period">b</p><section class="related-work">c</section><div class="cookie-notice">d</div><article>e</article></article><aside><article>f</article></aside>'
    assert extract(page, None, {}) == "T\na\nb\nc\ne"


def test_importance_decides_on_the_given_pages(spark, sf_dir):
    """With every style node as important as can be, menus, adverts and footers stay: no page reads as before."""
    import pandas as pd

    from quillon.llm.html import extract, main_text

    class Important(dict):
        def get(self, key, default=None):
            return True

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    got = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).toPandas().set_index("page_id").text
    assert all(extract(h, u, Important()) != got[k] for k, u, h in pages[["page_id", "url", "html"]].itertuples(index=False))


def test_deep_pages_take_linear_time():
    import time

    from quillon.llm.html import extract, styles

    begun = time.time()
    for deep in ("<div>" * 100_000 + "z", "<font>" * 100_000 + "z" + "</b>" * 100_000 + "<p>" * 10):
        assert extract(deep, "http://a.example/", {}) == "z" and len(styles(deep, "http://a.example/")) >= 100_000
    assert time.time() - begun < 60


def test_tags_that_never_end_take_linear_time():
    import time

    from quillon.llm.html import extract, styles

    for page in ("<a" * 100_000, "<p a='" * 100_000, '<p a="' * 99_999, "<!" * 100_000, "</b " * 100_000, "<a b='" + "<p>x</p>" * 50_000, "<![" * 100_000 + "<!--" * 100_000):
        begun = time.time()
        extract(page, "http://a.example/", {})
        styles(page, "http://a.example/")
        assert time.time() - begun < 3
    assert extract("<p>a</p><b>c <p title='x>d</p> 1 < 2 </1 <p>e", None, {}) == "a\nc\nd\n1 < 2 </1\ne" and extract("<p>a <b", None, {}) == "a <b"
