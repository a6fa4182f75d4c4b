import pytest
from pyspark.sql import functions as F

from narrata.llm import htmltext
from tests.llm.helpers import FOLDER

PAGES = "page_id long, url string, html string, text string, extra int"
LONG = "This is a paragraph of the article with quite a few words in it, so that it looks like one."


@pytest.fixture(scope="module")
def tree(spark):
    return htmltext.train_tree(spark)


def text_of(spark, tree, *htmls):
    rows = spark.createDataFrame([(i, "u", h, "old", 1) for i, h in enumerate(htmls)], PAGES)
    got = htmltext.main_text(rows, tree=tree)
    assert set(got.columns) == {"page_id", "url", "extra", "text", "n_chars"}
    out = {r["page_id"]: r for r in got.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    return [out[i]["text"] for i in range(len(htmls))]


def test_articles_of_several_layouts(spark, tree):
    a = f'<html><head><title>T</title><script>var x="</p>"</script></head><body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>{LONG}<p>Short.</p><p>a&nbsp;b\n  c<br>d &lt;tag&gt;</p></article><div class="comments"><p>{LONG}</p></div><footer>Foot</footer>'
    links = "<p><a href=1>One</a></p><p><a href=2>Two</a></p>"
    b = f'<div>{links}</div><h1>Title</h1><div class="entry-content"><p>{LONG} {LONG}</p><p>{LONG}</p><p>{LONG} {LONG}</p></div>{links}<form><p>{LONG}</p></form>'
    c = f"<body><div><a href=1>A</a> <a href=2>B</a></div><p>{LONG} {LONG}</p><p>{LONG} {LONG}</p><p><a href=3>Next page of the list</a></p></body>"
    assert text_of(spark, tree, a, b, c) == [f"Title & more\n{LONG}\nShort.\na b c d <tag>", f"Title\n{LONG} {LONG}\n{LONG}\n{LONG} {LONG}", f"{LONG} {LONG}\n{LONG} {LONG}"]


def test_names_of_classes_decide_nothing(spark, tree):
    story = f"<h1>Title</h1><p>{LONG}</p><p>{LONG} {LONG}</p><p>Short.</p>"
    wanted = f"Title\n{LONG}\n{LONG} {LONG}\nShort."
    pages = [
        f'<body class="no-sidebar"><article>{story}</article></body>', f'<div class="post-with-comments"><article>{story}</article></div>',
        f'<article class="sidebar footer"><h1>Title</h1><p>{LONG}</p><p id="related-work">{LONG} {LONG}</p><p>Short.</p></article>',
    ]
    assert text_of(spark, tree, *pages) == [wanted] * 3


def test_page_headers_links_comments_and_cut_tags(spark, tree):
    links = "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(3))
    remarks = "".join(f"<div><a href=u>reader{i}</a> <a href=d>{i} May</a></div><p>I was there and saw it all.</p><div><a href=r>Answer</a></div>" for i in range(3))
    header, listed, cut, remarked, hidden = text_of(
        spark, tree,
        f"<header><p>{LONG}</p></header><article><header><h1>Title</h1></header><p>{LONG}</p></article>",
        f"<nav><ul>{links}</ul></nav><article><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p></article>",
        f'<article><p>{LONG}</p><p class="fo',
        f"<div><a href=1>A</a> <a href=2>B</a></div><h1>Title</h1><p>{LONG} {LONG}</p><p>{LONG} {LONG}</p><p>{LONG} {LONG}</p><h3>Opinions</h3>{remarks}",
        f'<article><p>{LONG}</p><p hidden>No</p><p aria-hidden="true">No</p><p aria-hidden="false">Yes</p></article>',
    )
    assert header == f"Title\n{LONG}" and cut == LONG and hidden == f"{LONG}\nYes"
    assert listed == "\n".join([LONG, "Link number 0", "Link number 1", "Link number 2", LONG])
    assert "I was there" not in remarked and remarked.count(LONG) == 6


def test_the_tree_judges_by_words_and_links_of_block_and_neighbours(spark, tree):
    weight = dict(zip(htmltext.FEATURES, tree.featureImportances.toArray()))
    near = sum(w for f, w in weight.items() if f.startswith(("before", "after")))
    density = sum(w for f, w in weight.items() if f.endswith("link_density"))
    assert weight["words"] > 0.03 and weight["link_density"] > 0.03 and density > 0.05 and near > 0.03, weight
    # Held against pages that it hasn't seen.
    rows = [x for page in htmltext.labelled_pages(60, seed=99) for x in zip(htmltext.blocks_of(page.replace("[+]", "")), htmltext.blocks_of(page), strict=True)]
    told = spark.createDataFrame([(b["seen"], m["text"].endswith("[+]")) for b, m in rows], "seen array<double>, article boolean")
    right = told.select((htmltext._expression(tree._java_obj.rootNode(), F.col("seen")) == F.col("article").cast("double")).alias("ok"))
    assert right.where("ok").count() / len(rows) > 0.93


def test_pages_of_the_corpus_are_their_articles(spark, tree):
    import html
    import re

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages, tree=tree).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_odd_pages_have_defined_results(spark, tree):
    odd = [None, "", "<", "<p", "&#0;&bogus;", "<script>never closed <p>x", "<!-- never closed", "<a href='x>y</a>", "<p>" * 3000, "</p></div>" * 50, f"<article>{'<div>' * 300}{LONG}"]
    got = text_of(spark, tree, *odd)
    assert got[:2] == ["", ""] and got[5] == got[6] == "" and got[-1] == LONG
    empty = spark.createDataFrame([], PAGES)
    assert htmltext.main_text(empty, tree=tree).count() == 0
