"""Main text of pages: the given tables' layout, other layouts, odd markup."""

import html
import re

import pytest
from llm.helpers import SF, write_tables

from riskloom.llm import html_text, queries


def article_of(source):
    """The expected text of the given pages' layout, by plain string work."""
    inner = re.search(r"<article>(.*)</article>", source, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_query_on_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op7_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id])
        assert r.n_chars == len(r.text)


def layout(k):
    """Pages without article or main elements, whose frame tells nothing by its names."""
    body = "".join(f"<p>Paragraph {j} of page {k} tells story number {k * 7 + j} at some length.</p>" for j in range(4))
    return ("<html><body><div id=top><p>The Example Daily, all the news</p><a href=/>Home</a> <a href=/x>World</a></div>"
            f"<div id=wrap><div id=left><p>We are 3 km from you</p></div><div id=text><h2>Title {k}</h2>{body}</div></div>"
            "<div id=bottom><p>All rights with us</p></div></body></html>")


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.main_text(df).collect()}


def test_template_without_semantic_names(spark):
    got = run(spark, [(k, f"http://h.net/{k}", layout(k)) for k in range(6)])
    for k, text in got.items():
        lines = [f"Title {k}", *[f"Paragraph {j} of page {k} tells story number {k * 7 + j} at some length." for j in range(4)]]
        assert text == "\n".join(lines)


FRAME = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class='has-sidebar'>"
         "<header class=site><h1>Site</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header>"
         "<div class='cookie-notice'><p>We use cookies</p></div><aside><p>Side</p></aside>{main}"
         "<section id=comments><h3>Comments</h3><ol class=commentlist><li><p>First!</p></li></ol></section>"
         "<form action=/s><label>Search</label><input name=q></form><footer><p>Foot</p></footer></body></html>")
MAIN = [
    ("<main><article><header><h1>Head</h1></header><p>One &amp; two.</p><div class=advertisement>Buy</div><p>Three.</p>"
     "</article></main>", "Head\nOne & two.\nThree."),
    ("<div class='post-content'><h1>Head</h1><p>One<p>Two<br>lines<ul><li>a</li><li>b <a href=x>c</a></li></ul></div>",
     "Head\nOne\nTwo lines\na\nb c"),
    ("<article><h1>A  <b>b</b>\n c</h1><p>x<!-- no --><script>var a='<p>no</p>';</script>y&nbsp;z</p><p hidden>no</p>"
     "<ul class=x><li><a href=1>m1</a></li><li><a href=2>m2</a></li></ul><div class='reader comments'>no</div></article>",
     "A b c\nxy z"),
    ("<div role=main><table><tr><td>1<td>2<tr><td>3</table><blockquote>q</blockquote>loose text</div>", "1\n2\n3\nq\nloose text"),
]


@pytest.mark.parametrize("k", range(len(MAIN)))
def test_layouts(spark, k):
    main, want = MAIN[k]
    got = run(spark, [(j, f"http://h{k}.org/{j}", FRAME.replace("{main}", main)) for j in range(2)])
    assert set(got.values()) == {want}


def test_odd_pages(spark, tmp_path):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.b/", "plain text"), (4, "http://a.b/", "<p>a<p>b"),
            (5, "http://a.b/x", "<article>un<b>closed"), (6, "x", "<!-- never closed <p>x"), (7, "http://a.b/", "a < b <3 & c &lt; d"),
            (8, "http://a.b/", "<a href='x>y"), (None, "http://a.b/", "<script>never"), (8, "http://a.b/", "<p" + " x" * 20000),
            (9, "http://a.b/", "<div>" * 3000 + "deep" + "</div>" * 10), (10, "http://c.d/", "</p></div><p>x</p></body></html>")]
    df = spark.createDataFrame([(*r, "t", "s") for r in rows], "page_id long, url string, html string, host string, token string")
    got = queries.op7_html_text(spark, write_tables(spark, tmp_path, pages=df)).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got if r.page_id != 8}
    assert texts[1] == texts[2] == "" and texts[3] == "plain text" and texts[4] == "a\nb" and texts[5] == "unclosed"
    assert texts[7] == "a < b <3 & c < d" and texts[9] == "deep" and texts[10] == "x"
    out = html_text.main_text(df, to="clean")
    assert out.columns == [*df.columns, "clean"]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_classes_share_occurrence_vectors(spark):
    df = spark.createDataFrame([(k, f"http://h.net/{k}", layout(k)) for k in range(6)], "page_id long, url string, html string")
    classes = html_text.equivalence_classes(df)
    root = classes.filter("token = ''").first()
    skeleton = {r.token for r in classes.collect() if (r.low, r.high) == (root.low, root.high)}
    assert {"html/body", "html/body/div#wrap/div#text"} <= skeleton
    assert "html/body/div#wrap/div#text/p" not in skeleton  # four times on each page: another class


STORY = "<h1>Head</h1><p>{0}</p><p>{1}</p>".format("A long paragraph of the story. " * 4, "And another one of it. " * 4)
TOLD = "\n".join(["Head", " ".join(["A long paragraph of the story."] * 4), " ".join(["And another one of it."] * 4)])


@pytest.mark.parametrize("open_, close", [
    ("<div class='content with-sidebar'>", "</div>"), ("<div class=no-comments>", "</div>"),
    ("<section class='search-result'>", "</section>"), ("<div id=legal-text>", "</div>"), ("<span class=popular>", "</span>")])
def test_wrapper_with_a_boilerplate_word_keeps_its_text(spark, open_, close):
    page = f"<html><body>{open_}{STORY}{close}<div class=sidebar><p>Side</p></div></body></html>"
    assert run(spark, [(1, "http://a.b/1", page)])[1] == TOLD


def test_words_drop_nothing_when_nothing_else_is_left(spark):
    page = "<html><body><div class=notice><p>One text.</p></div><div class=alert><p>Two text.</p></div></body></html>"
    assert run(spark, [(1, "http://a.b/1", page)])[1] == "One text.\nTwo text."


def test_long_comments_beside_the_article_are_dropped(spark):
    page = ("<html><body><article><h1>Head</h1><p>" + "Story text. " * 20 + "</p></article><div class=comments><p>"
            + "Some reader says. " * 30 + "</p></div></body></html>")
    assert "reader" not in run(spark, [(1, "http://a.b/1", page)])[1]


def test_pages_without_text_leave_the_template_as_it_is(spark):
    rows = [(k, f"http://h.net/{k}", layout(k)) for k in range(6)]
    empty = [(10, "http://h.net/n", None), (11, "http://h.net/e", ""), (12, "http://h.net/s", "<html><body></body></html>")]
    got = run(spark, rows + empty)
    assert got == run(spark, rows) | {10: "", 11: "", 12: ""}
    # texts of the main slot that are on every page with text are template still
    same = [(k, f"http://h.net/{k}", f"<article><p>Share this now</p><p>Story {k} at length.</p></article>") for k in range(5)]
    assert run(spark, same + empty) == {k: f"Story {k} at length." for k in range(5)} | {10: "", 11: "", 12: ""}


@pytest.mark.parametrize("open_, close", [
    ("<form id=aspnetForm>", "</form>"), ("<div role=note>", "</div>"), ("<div aria-hidden=true>", "</div>"), ("<div hidden>", "</div>")])
def test_wrapper_that_is_only_evidence_keeps_its_text(spark, open_, close):
    page = f"<html><body>{open_}{STORY}<form><label>Find</label></form>{close}<div role=note><p>By the way</p></div></body></html>"
    assert run(spark, [(1, "http://a.b/1", page)])[1] == TOLD


def test_words_in_attribute_values_are_no_attributes(spark):
    page = f"<html><body style=overflow:hidden data-x='class=ad hidden'><div title=\"role=form\">{STORY}</div></body></html>"
    assert run(spark, [(1, "http://a.b/1", page)])[1] == TOLD


def test_headings_of_the_article_stay(spark):
    rows = [(k, f"http://h.net/{k}", f"<article><h1>T {k}</h1><h2>Summary</h2><p>Story {k} is told.</p></article>") for k in range(6)]
    assert run(spark, rows) == {k: f"T {k}\nSummary\nStory {k} is told." for k in range(6)}


@pytest.mark.parametrize("on, times", [(10, 1), (9, 1), (7, 1), (10, 2), (8, 2)])
def test_lines_of_most_pages_are_template(spark, on, times):
    """Also if an odd page lacks them, or if they stand twice on each page."""
    line = "<div class=x><span>Read this with our app</span></div>" * times
    rows = [(k, f"http://h.net/{k}", f"<article><h1>T {k}</h1>{line if k < on else ''}"
             f"<p>Story {k} is told at some length here.</p></article>") for k in range(10)]
    assert run(spark, rows) == {k: f"T {k}\nStory {k} is told at some length here." for k in range(10)}


def test_classes_nest(spark):
    """A note on most pages is a class of its own inside the skeleton; what repeats unevenly is none."""
    note = "<div id=note><b>Note</b><p>Our shop is open</p></div>"
    rows = [(k, f"http://h.net/{k}", f"<html><body>{note if k % 4 else ''}<div id=t>" + "<p>line</p>" * (k % 3 + 1)
             + f"<h2>Story {k}</h2></div></body></html>") for k in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    classes = html_text.equivalence_classes(df)
    found = {frozenset(t.split("\n")[0] for t in r.tokens): r for r in html_text.nested(classes).collect()}
    root = next(r for k, r in found.items() if "" in k)
    inner = next(r for k, r in found.items() if "html/body/div#note" in k)
    assert root.parent is None and (inner.parent.low, inner.parent.high) == (root.low, root.high)
    assert not any("html/body/div#t/p" in k for k in found)


def test_deep_pages_take_linear_time():
    import time
    import tracemalloc

    source = "<div class=some-name>" * 10_000 + "text" + "</div>" * 10_000
    start = time.process_time()
    assert html_text.extract(source, "", None) == "text"
    assert html_text.tokens_of(source)
    assert time.process_time() - start < 3
    tracemalloc.start()
    html_text.tokens_of(source)
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()
