import html
import re

import pytest
from pyspark.sql import functions as F

from voxelarium.llm.main_text import extract, main_text, node_importance, page_texts

SF = "/root/testdata/sf0.01"


def article(source):
    """The article of the test pages, taken apart by their known layout."""
    inner = source[source.index("<article>") + 9 :].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1)>", inner)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts) if x)


def test_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in page_texts(pages).collect()}
    want = pages.select("page_id", "html").collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(article(r["html"]))


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""),
        ("<p>a", "a"),
        ("plain  text", "plain text"),
        ("<p>x<br>y <b>z</p>w", "x y z\nw"),
        ("<div class='reader comments'>no</div><p>yes", "yes"),
        ("<article><header><h1>T</h1></header><p>a</p><form>f</form></article><p>out", "T\na"),
        ("<header>h</header><div id=side-bar>s</div><p>a", "s\na"),
        ("a &lt;b&gt; &amp;amp; &#233;<p title='>'>q</p>", "a <b> &amp; é\nq"),
        ("<script>var a='</p>'</script>t<style>p{}</style>", "t"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a\nb\n1\n2"),
        ("<p hidden>h</p><p style='display: none'>n</p>v", "v"),
        ("a <!-- b --> c <!-- open", "a c"),
        ("1 < 2 <p", "1 < 2"),
        ("</div></p>a</b>", "a"),
        ("<p title=\"open>a", "a"),
        ("<p>" * 2000 + "deep" + "<div>" * 2000 + "end", "deep\nend"),
    ],
)
def test_extract(source, text):
    assert extract(source, ()) == text


@pytest.fixture(scope="module")
def site(spark):
    rows = []
    for i in range(40):
        body = f"<div class=top>Our great site</div><div class=box><p>Story {i} tells of matter {i * i}.</p><p>More on {i}.</p></div>"
        rows.append((i, "http://a.example/x", body + f"<div class=end><p>All rights {i % 2}</p></div>", "c", "y"))
    rows += [(100, None, "<p>null url</p>", "c", "y"), (101, "::", None, "c", "y"), (102, "http://b.example", "", "c", "y")]
    rows += [(103, "http://c.example/", "<p>Twin page</p>", "c", "y")] * 2
    return spark.createDataFrame(rows, "page_id long, url string, html string, host_name string, text string")


def test_repeated_branches_go(site):
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in main_text(site).collect()]
    assert (3, "Story 3 tells of matter 9.\nMore on 3.", 37) in got
    assert (100, "null url", 8) in got and (101, "", 0) in got and (102, "", 0) in got
    assert got.count((103, "Twin page", 9)) == 2 and len(got) == 45
    assert set(main_text(site).columns) == {"page_id", "url", "html", "host_name", "text", "n_chars"}


def test_importance(site):
    rows = node_importance(site).filter("host = 'a.example'").orderBy("importance").collect()
    assert all(0 <= r["importance"] <= 1 for r in rows)
    assert rows[0]["content"] == pytest.approx(0) and rows[-1]["content"] == pytest.approx(1)


def test_empty_table(site):
    assert page_texts(site.filter(F.lit(False))).count() == 0


def test_copies_do_not_change_any_text(spark):
    def page(i):
        return f"<article><h1>Title {i}</h1><p>Story {i} of matter {i * i}.</p><ul><li>Point {i}</li></ul></article>"

    copy = "<article><h1>Title</h1><p>The copied story.</p></article>"
    rows = [(i, "http://a.example/", page(i)) for i in range(10)] + [(100, "http://a.example/", copy)]
    more = rows + [(100 + k, "http://a.example/", copy) for k in range(1, 90)]
    schema = "page_id long, url string, html string"
    once, many = ({r["page_id"]: r["text"] for r in page_texts(spark.createDataFrame(x, schema)).collect()} for x in (rows, more))
    assert once == {i: t for i, t in many.items() if i in once}
    assert many[3] == "Title 3\nStory 3 of matter 9.\nPoint 3" and many[150] == "Title\nThe copied story."


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><h1><a href=x>Linked headline</a></h1><p>a</p></article>", "Linked headline\na"),
        ("<main><p>a</p><p><a href=x>A linked paragraph.</a></p></main>", "a\nA linked paragraph."),
        ("<article><p>a</p><ol><li><a href=x>Reference</a></ol></article>", "a\nReference"),
        ("<article><h2 id=social-impact>Social impact</h2><p>a</p></article>", "Social impact\na"),
        ("<article><section id=related-work><p>b</p></section><p id=notice-of-appeal>c</p></article>", "b\nc"),
        ("<article><p>a</p><div class=comment-analysis><p>d</p></div></article>", "a\nd"),
        ("<article><p>a</p><div class='box related'><p>no</p></div></article>", "a"),
        ("<p><a href=x>menu</a></p><div id=social-bar>no</div><p>a</p>", "a"),
    ],
)
def test_article_text_with_links_and_slugs_stays(source, text):
    assert extract(source, ()) == text
