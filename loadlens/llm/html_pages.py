"""Labelled pages to train the extraction on: fixed kinds of page parts, put together by a seeded draw.

The main part carries ``data-main``; the trainer reads it as the label and takes it off.
"""

from __future__ import annotations

import random

# Parts of pages and the names they commonly bear.
MAIN_TAGS = ("article", "main", "div", "section")
MAIN_NAMES = ("content", "post", "entry", "article body", "main text", "story", "post content", "")
ASIDE = {
    "nav": ("menu", "navigation", "breadcrumb", "navbar", "nav", ""),
    "header": ("site header", "masthead", "topbar", "header", ""),
    "footer": ("site footer", "footer", "copyright", ""),
    "aside": ("sidebar", "widget", "related", "aside", ""),
    "form": ("search form", "newsletter", "login", "subscribe", ""),
}
BOXES = (
    "ad", "ads", "advert", "banner ad", "sponsored", "promo", "cookie notice", "notice", "cookie banner", "consent",
    "popup modal", "comments", "comment list", "reader comments", "comment", "disqus thread", "share social", "related links",
    "sidebar", "menu", "nav", "header", "footer", "newsletter signup", "breadcrumbs", "login form", "tags", "recommended",
)
WORDS = (
    "the of and to in that it was on are with this from they year water house people report city new light "
    "le la les des une que dans par der die das und nicht mit ein el los las una con por para"
).split()


def _text(draw: random.Random, least: int, most: int) -> str:
    words = [draw.choice(WORDS) + draw.choice(("", "", "en", "er", "a", "tion")) for _ in range(draw.randint(least, most))]
    if draw.random() < 0.25:
        return " ".join(words) if draw.random() < 0.5 else " | ".join(words)
    for i in range(0, len(words), draw.randint(6, 14)):
        words[i] = words[i].capitalize()
        words[i - 1] += "."
    return " ".join(words)


def _links(draw: random.Random) -> str:
    items = "".join(f'<li><a href="/{i}">{_text(draw, 1, 4)}</a></li>' for i in range(draw.randint(2, 8)))
    return f"<ul>{items}</ul>"


def _attributes(draw: random.Random, name: str) -> str:
    name = name.replace(" ", draw.choice((" ", "-", "_")))
    return f' {draw.choice(("class", "class", "id"))}="{name}"' if name else ""


def _part(draw: random.Random) -> str:
    if draw.random() < 0.55:
        tag = draw.choice(list(ASIDE))
        name = draw.choice(ASIDE[tag])
    else:
        tag, name = draw.choice(("div", "div", "section", "ul")), draw.choice(BOXES)
    inner = draw.choice(
        (
            _links(draw), f"<p>{_text(draw, 3, 60)}</p>", _text(draw, 3, 30), f"<div><span>{_text(draw, 2, 12)}</span></div>",
            f"<h3>{_text(draw, 1, 4)}</h3>{_links(draw)}", f"<p>{_text(draw, 5, 40)}</p><p>{_text(draw, 5, 40)}</p>",
        )
    )
    if tag == "form":
        inner = f"<label>{_text(draw, 1, 3)}</label><input name=q><button>{_text(draw, 1, 2)}</button>" + draw.choice(("", inner))
    return f"<{tag}{_attributes(draw, name)}>{inner}</{tag}>"


def _main(draw: random.Random) -> str:
    body = []
    if draw.random() < 0.8:
        body.append(f"<h1>{_text(draw, 2, 12)}</h1>")
    for _ in range(draw.randint(0, 9)):
        size = draw.choice(((1, 4), (5, 30), (20, 120)))
        body.append(
            draw.choice(
                (
                    f"<p>{_text(draw, *size)}</p>", f"<p>{_text(draw, *size)}</p>", f"<p>{_text(draw, *size)}</p>",
                    f"<p><b>{_text(draw, *size)}<br>", f"<h2>{_text(draw, 1, 6)}</h2>", f"<blockquote>{_text(draw, *size)}</blockquote>",
                    f"<ul><li>{_text(draw, 2, 20)}</li><li>{_text(draw, 2, 20)}</li></ul>", f"<div>{_text(draw, *size)}</div>",
                    f"<p>{_text(draw, 4, 30)} <a href='/x'>{_text(draw, 1, 3)}</a> <i>{_text(draw, 1, 5)}</i></p>",
                    f"<table><tr><td>{_text(draw, 1, 4)}</td><td>{_text(draw, 1, 4)}</td></tr></table>", f"<pre>{_text(draw, 4, 20)}</pre>",
                )
            )
        )
    if draw.random() < 0.25:
        body.insert(draw.randint(0, len(body)), f'<div{_attributes(draw, draw.choice(BOXES))} data-main="0">{_text(draw, 3, 20)}</div>')
    tag = draw.choice(MAIN_TAGS)
    name = draw.choice(MAIN_NAMES[:-1] if tag in ("div", "section") else MAIN_NAMES)
    return f'<{tag}{_attributes(draw, name)} data-main="1">{"".join(body)}</{tag}>'


def labelled_pages(n: int = 400, seed: int = 9) -> list[str]:
    """``n`` pages; the same for the same seed."""
    draw = random.Random(seed)
    pages = []
    for _ in range(n):
        before = "".join(_part(draw) for _ in range(draw.randint(0, 4)))
        after = "".join(_part(draw) for _ in range(draw.randint(0, 4)))
        inner = before + _main(draw) + after
        for _ in range(draw.randint(0, 2)):
            inner = f'<div{_attributes(draw, draw.choice(("page", "wrapper", "container", "")))}>{inner}</div>'
        pages.append(f"<html><head><title>x</title></head><body>{inner}</body></html>")
    return pages
