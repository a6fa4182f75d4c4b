"""Main text of web pages: flat text blocks, judged by a decision tree on themselves and their neighbours.

Each page becomes a flat list of text blocks. What the tree sees of a block is its word count and link
density, those of the two blocks before and the two after it, and what the tags around it say. Classes
and ids aren't looked at. The tree is trained by Spark on the blocks of a small table of labelled pages,
and applied as a column expression inside higher-order functions, so a page is read once and never shuffled.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.htmlsamples import LABELLED_PAGES, labelled_pages  # noqa: F401  (tests hold the tree against other pages)

#: Elements that start and end a block.
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page.
_SILENT_TAGS = frozenset("head iframe math noembed noframes noscript object script style svg template textarea title".split())
#: Elements without an end tag.
_VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an equal open element is closed by.
_CLOSED_BY_SAME = frozenset("p li dt dd td th tr option".split())
#: Elements that hold what isn't the article, and that hold the article. A header is of the page unless in an article.
_CHROME_TAGS = frozenset("aside button dialog footer form label menu nav search select".split())
_MAIN_TAGS = frozenset(["article", "main"])

#: Comments, declarations, tags, and a tag or comment that the page ends in.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<![^>]*>|<\?[^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[/!?]?\Z""",
    re.S,
)
_HIDDEN = re.compile(r"""(?:^|\s)(?:aria-)?hidden(?:\s*=\s*["']?(?!["']?false)|(?=[\s/]|$))""", re.I)

#: What the tree sees of a block: itself, its tags, then the two blocks before and the two after it.
FEATURES = (
    "words", "link_density", "chrome", "main", "heading", "outside_main", "before_words", "before_link_density", "after_words", "after_link_density",
    "before2_words", "before2_link_density", "after2_words", "after2_link_density",
)
#: Words from which blocks look alike to the tree.
_LONG_BLOCK = 40
_BLOCK_TYPE = "array<struct<text:string,seen:array<double>>>"


def blocks_of(page: str | None) -> list[dict]:
    """The text blocks of a page in order, each with ``seen``, its FEATURES; none for null."""
    page = page or ""
    blocks: list[dict] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, chrome, main, each with all around it
    parts: list[tuple[str, bool]] = []  # of the current block: text, and whether it is in a link
    state = {"link": 0, "heading": False}

    def close_block() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len("".join(t.split())) for t, in_link in parts if in_link)
            _, chrome, main = stack[-1] if stack else ("", False, False)
            density = linked / max(1, len("".join(text.split())))
            blocks.append({"text": text, "words": float(min(_LONG_BLOCK, len(text.split()))), "density": density, "tags": [float(chrome), float(main), float(state["heading"])]})
        parts.clear()

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if (found.start() if found else len(page)) > at:
            parts.append((html.unescape(page[at : found.start() if found else len(page)]), state["link"] > 0))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closing = bool(found[1])
        if tag in _SILENT_TAGS:
            if not closing and not found[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag != "head":  # a head that nothing ends goes on as the page
                    at = len(page)
            continue
        if tag == "br":
            parts.append((" ", state["link"] > 0))
            continue
        if tag in _BLOCK_TAGS:
            close_block()
            state["heading"] = not closing and re.fullmatch("h[1-6]", tag) is not None
        if tag == "a":
            state["link"] = 0 if closing else 1
        if tag in _VOID_TAGS:
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in _CLOSED_BY_SAME and any(x[0] == tag for x in stack[-3:]):
            while stack[-1][0] != tag:
                stack.pop()
            stack.pop()
        _, chrome, main = stack[-1] if stack else ("", False, False)
        chrome = chrome or tag in _CHROME_TAGS or (tag == "header" and not main) or (tag not in ("html", "body") and _HIDDEN.search(found[3] or "") is not None)
        stack.append((tag, chrome, main or tag in _MAIN_TAGS))
    close_block()
    has_main = any(main and not chrome for chrome, main, _ in (b["tags"] for b in blocks))
    nothing = {"words": 0.0, "density": 0.0}
    around = [nothing, nothing, *blocks, nothing, nothing]
    return [
        {"text": b["text"], "seen": [b["words"], b["density"], *b["tags"], float(has_main and not b["tags"][1]), *(x for n in (1, 3, 0, 4) for x in (around[i + n]["words"], around[i + n]["density"]))]}
        for i, b in enumerate(blocks)
    ]


def _blocks(pages: pd.Series) -> pd.Series:
    return pd.Series([blocks_of(p) for p in pages], dtype="object")


def _expression(node, seen: Column) -> Column:
    """A node of a trained tree as a column: the class that it predicts."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    low = seen[split.featureIndex()] <= F.lit(float(split.threshold()))
    return F.when(low, _expression(node.leftChild(), seen)).otherwise(_expression(node.rightChild(), seen))


def train_tree(spark: SparkSession, samples: tuple[str, ...] = LABELLED_PAGES, max_depth: int = 10) -> DecisionTreeClassificationModel:
    """A decision tree on the blocks of the labelled pages; blocks of the article end in the mark ``[+]`` there."""
    # Features are those of the page without its marks, which would count as letters outside links.
    rows = spark.createDataFrame([(s, s.replace("[+]", "")) for s in samples], "marked string, html string")
    parsed = F.pandas_udf(_blocks, _BLOCK_TYPE)
    pairs = rows.select(F.explode(F.arrays_zip(parsed("html").alias("b"), parsed("marked").alias("m"))).alias("x"))
    marked = pairs.select(array_to_vector(F.col("x.b.seen")).alias("features"), F.when(F.col("x.m.text").endswith("[+]"), 1.0).otherwise(0.0).alias("label"))
    return DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=5, impurity="gini", seed=1).fit(marked)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tree: DecisionTreeClassificationModel | None = None) -> DataFrame:
    """``pages`` without the HTML, with ``text`` (blocks of the article joined by a line feed) and ``n_chars``.

    Null and empty pages have an empty text; pages may be cut off anywhere; repeated pages give repeated
    rows; columns named ``text`` or ``n_chars`` are replaced, other extra columns pass through.
    """
    tree = tree or train_tree(pages.sparkSession)
    root = tree._java_obj.rootNode()
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    judged = F.filter("_narrata_blocks", lambda b: _expression(root, b["seen"]) == 1.0)
    return (
        pages.select(*(F.col(c) for c in others), F.pandas_udf(_blocks, _BLOCK_TYPE)(F.col(html_col)).alias("_narrata_blocks"))
        .select(*others, F.array_join(F.transform(judged, lambda b: b["text"]), "\n").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
