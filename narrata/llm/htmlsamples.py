"""A small labelled table of pages: blocks of the article end in ``[+]``.

Pages are put together by rule from sentences and layouts. No layout names its parts by class or id:
what is article follows from tags, word counts, link densities and the blocks around.
"""

from __future__ import annotations

from random import Random

_SENTENCES = (
    "The river had risen twice since the spring and the old bridge no longer looked as if it would last another winter.",
    "Nobody in the village could say who had built it, or when, although every family had a story about the builder.",
    "On the third morning the surveyor came back with two assistants, a long chain and a box of brass instruments.",
    "They measured until noon, ate bread and cheese on the wall, and went on measuring until it was too dark to read.",
    "The council met twice.", "It held.", "Stone is dear here, and iron is dearer still.", "By then the water stood at the second arch.",
    "What the engineer wrote in his report was read aloud in the inn that evening, first with laughter, then in silence.",
    "A ferry was found and hired for the summer.", "Nothing else crossed the river for eleven weeks.",
)
_TITLES = ("The bridge", "Iron and stone", "What the river took", "A report on the works at the mill", "After the flood")
_LINKS = ("Home", "World", "Sport", "About us", "Archive", "Contact", "The old mill", "May", "June", "Log in", "Weather", "How the town was built", "Next page", "Print this page")
_NOTICES = (
    "We use cookies to make this site better for everyone.", "Buy our boots now, they are the best boots in town.", "This page was changed last week.",
    "Subscribe to our letter and never miss a story again, it is free and comes once a week to all who ask for it.", "Give us your name.",
)
_OPINIONS = (
    "I saw it myself and it was just as the paper says, every word.", "My grandfather worked there.", "Nonsense, the bridge was never closed.",
    "Thank you for this piece, I had long wondered what became of the surveyor and of his brass instruments after that summer.",
)
_FEET = ("&copy; 1901 all rights reserved", "Written at home with care", "Contact and imprint", "Terms of use")


def _links(rng: Random, n: int, tag: str = "li", around: str = "ul") -> str:
    return f"<{around}>" + "".join(f"<{tag}><a href='/{i}'>{_link(rng)}</a></{tag}>" for i in range(n)) + f"</{around}>"


def _link(rng: Random) -> str:
    """What a link says: a word or two, or a whole headline."""
    return rng.choice(_LINKS) if rng.random() < 0.5 else rng.choice(_SENTENCES[:4] + _SENTENCES[8:]).rstrip(".")


def _title(rng: Random) -> str:
    return rng.choice(_TITLES if rng.random() < 0.5 else _SENTENCES).rstrip(".")


def _row(rng: Random, n: int) -> str:
    return "<div>" + " | ".join(f"<a href='/{i}'>{_link(rng)}</a>" for i in range(n)) + "</div>"


def _paragraph(rng: Random, least: int = 1, most: int = 4) -> str:
    text = " ".join(rng.choice(_SENTENCES) for _ in range(rng.randint(least, most)))
    if rng.random() < 0.25:
        text += " See <a href='/z'>the plan of the bridge</a> for more."
    return f"<p>{text}[+]</p>"


def _story(rng: Random, n: int, whole: bool) -> str:
    """Paragraphs of an article; where its element tells (``whole``), short ones and lists of links are in it too."""
    parts = [_paragraph(rng, 1 if whole or 0 < i < n - 1 else 2) for i in range(n)]
    if whole:
        parts.insert(rng.randint(1, n), "<ul>" + "".join(f"<li><a href='/{i}'>{rng.choice(_LINKS)}</a>[+]</li>" for i in range(3)) + "</ul>")
        parts.insert(rng.randint(1, n), f"<p><a href='/w'>{rng.choice(_LINKS)}</a>[+]</p>")
        parts.insert(rng.randint(1, n), "<p>Yes.[+]</p><h2>After[+]</h2>")
        parts.insert(rng.randint(1, n), "<table><tr><td>Length[+]</td><td>40 m[+]</td></tr></table>")
    return "".join(parts)


def _comments(rng: Random, n: int) -> str:
    """Opinions, each after a line of links that names its writer and before one to answer it."""
    return "".join(f"<div><a href='/u{i}'>reader{i}</a> <a href='/at{i}'>{i + 1} May</a></div><p>{rng.choice(_OPINIONS)}</p><div><a href='/r{i}'>Answer</a></div>" for i in range(n))


def _article(rng: Random) -> str:
    """An article element, with what isn't it around it and in elements of it that say so."""
    notice, title = rng.choice(_NOTICES), _title(rng)
    inside = rng.choice(("", f"<aside>{rng.choice(_SENTENCES)}</aside>", f"<nav>{_links(rng, 3)}</nav>", f"<form><label>Name</label><p>{notice}</p></form>", f"<footer>{rng.choice(_FEET)}</footer>"))
    tag = rng.choice(("article", "article", "main"))
    head = f"<header><h1>{title}[+]</h1></header>" if rng.random() < 0.3 else f"<h1>{title}[+]</h1>"
    story = _story(rng, rng.randint(1, 6), True)
    before = rng.choice((f"<header><p>{rng.choice(_SENTENCES)}</p></header>", f"<nav>{_links(rng, 6)}</nav>", _row(rng, 4))) + rng.choice(("", f"<div>{notice}</div>", f"<p>{rng.choice(_SENTENCES)}</p>", f"<div>{rng.choice(_SENTENCES)} {notice}</div>"))
    after = rng.choice(("", f"<section><h3>Opinions</h3>{_comments(rng, 3)}</section>", f"<div><p>{rng.choice(_OPINIONS)}</p><p>{rng.choice(_SENTENCES)}</p></div>"))
    return f"{before}<{tag}>{head}{story}{inside}{_paragraph(rng)}</{tag}>{after}<footer>{rng.choice(_FEET)}</footer>"


def _blocks(rng: Random) -> str:
    """An article among plain blocks: links before and after it, notices and opinions between lines of links."""
    title = f"<h1>{_title(rng)}[+]</h1>" if rng.random() < 0.8 else ""
    before = rng.choice((_row(rng, 4), _links(rng, 5), _links(rng, 3, "p", "div"))) + rng.choice(("", f"<div>{rng.choice(_NOTICES)}</div>" + _row(rng, 2)))
    after = rng.choice((_row(rng, 3), _links(rng, 4), "")) + rng.choice(("", "<h3>Opinions</h3>" + _comments(rng, 4), f"<h4>Archive</h4>{_links(rng, 4)}"))
    return f"{before}{title}{_story(rng, rng.randint(2, 6), False)}{after}" + rng.choice((f"<div>{rng.choice(_FEET)}</div>", f"<footer>{rng.choice(_FEET)}</footer>", ""))


def labelled_pages(n: int = 1000, seed: int = 7) -> tuple[str, ...]:
    """``n`` pages of both layouts, some of them cut off."""
    rng = Random(seed)
    pages = []
    for i in range(n):
        body = (_article if i % 2 else _blocks)(rng)
        if i % 8 > 5:
            body = body[: body.rfind("[+]") + 3] + rng.choice(("", "</p><div class='fo", "</p><p"))
        pages.append(f"<html><head><title>Page</title><script>var a = '</p>';</script></head><body>{body}")
    return tuple(pages)


LABELLED_PAGES: tuple[str, ...] = labelled_pages()
