"""Labelled pages on which the block model is trained: many layouts made from a rule, with the blocks' labels."""

from __future__ import annotations

import random
from html import escape

SYLLABLES = "an be co da el fi go ha in jo ka lu mi no or pa qu re su ta un ve wi xa yo ze ser tion ment ing".split()
MENU = "Home About Contact News Products Login Archive Search Help Shop Blog Team Jobs Press".split()
NOTICES = (
    "We use cookies to improve this site. Accept all", "Subscribe to our newsletter", "Sign up for updates", "This site uses cookies",
    "Please enable scripts", "You have one new notice", "Log in to continue",
)
ADVERTS = ("Buy now and save", "Sponsored", "Advertisement", "Best offers today", "Limited offer, click here")
FOOTERS = ("© 2024 Example. All rights reserved.", "Copyright Example Ltd", "Privacy policy | Terms of use", "Imprint")
#: Words that a long text of either kind may mention.
MENTIONS = "cookie cookies copyright privacy comment comments subscribe newsletter click offer advert sponsor reply".split()
#: Containers of the article, and what may hold each kind of the rest; in each a choice of tag and attributes.
ARTICLE = ("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="entry article"', 'div class="story text"', 'article class="post"', 'article itemprop="articleBody"')
HOLDERS = {
    "menu": ("nav", 'div class="menu"', 'ul id="nav"', 'div class="navigation"', 'div class="breadcrumb"', 'div role="navigation"', 'div class="tabs menu"'),
    "head": ("header", 'div id="header"', 'div class="site-header"', 'div class="masthead"', 'div role="banner"', 'div class="top bar"'),
    "foot": ("footer", 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"'),
    "side": ("aside", 'div class="sidebar"', 'div id="side"', 'div class="related links"', 'div class="widget"', 'section class="recommended"', 'div class="popular tags"', 'div role="complementary"', 'div class="share social"'),
    "advert": ('div class="ad"', 'div class="advert"', 'div class="ads banner"', 'div id="promo"', 'aside class="sponsored"', 'div class="advertisement"', 'div class="sponsor ad box"'),
    "notice": ('div class="cookie-notice"', 'div id="cookies"', 'div class="notice"', 'div class="popup modal"', 'div class="alert"', 'div class="newsletter subscribe"', 'div role="alert"', 'div role="dialog"', 'div class="consent gdpr"', 'div class="disclaimer"'),
    "form": ("form", 'form class="search"', 'form id="login"'),
    "comments": ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="comments"', 'div class="discussion replies"', 'section id="responses" class="comment"'),
}


def _prose(rng: random.Random, words: int) -> str:
    out = []
    while len(out) < words:
        n = min(rng.randrange(4, 16), words - len(out))
        sentence = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
        sentence[0] = sentence[0].capitalize()
        sentence[-1] += rng.choice(("..", ".", ".", "?"))[-1:]
        out += sentence
    if words > 30 and rng.random() < 0.3:
        for _ in range(rng.randrange(1, 3)):
            out[rng.randrange(1, len(out))] = rng.choice(MENTIONS)
    noise = rng.random()
    if noise < 0.1:
        out = [w + rng.choice(("***", "&&&", "$$$", "%%%")) for w in out]
    elif noise < 0.15:
        out = [w.upper() + "!!" for w in out]
    return " ".join(out)


def _told(rng: random.Random, signs: tuple[str, ...]) -> str:
    """A long block that isn't the article's, whose telling words come anywhere in it."""
    parts = [_prose(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 4))] + [rng.choice(signs) for _ in range(rng.randrange(1, 4))]
    rng.shuffle(parts)
    return " ".join(parts)


def labelled_page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """A page, and the texts of its blocks in order with 1 for the article's."""
    rng = random.Random(seed)
    html, labels = [], []

    def put(text: str, label: int, tag: str):
        labels.append((" ".join(text.split()), label))
        end = "" if tag == "p" and rng.random() < 0.15 else f"</{tag.split()[0]}>"
        html.append(f"<{tag}>{escape(text, quote=False)}{end}")

    def box(tag: str, fill):
        html.append(f"<{tag}>")
        fill()
        html.append(f"</{tag.split()[0]}>")

    def links(n: int, listed: bool):
        for _ in range(n):
            text = rng.choice((rng.choice(MENU), _prose(rng, rng.randrange(1, 5))))
            labels.append((" ".join(text.split()), 0))
            html.append(f'<li><a href="/x">{escape(text, quote=False)}</a></li>' if listed else f'<div><a href="/x">{escape(text, quote=False)}</a></div>')

    def other(kind: str):
        tag = rng.choice(HOLDERS[kind])
        if kind == "menu":
            box(tag, lambda: box("ul", lambda: links(rng.randrange(2, 8), True)) if not tag.startswith("ul") else links(3, True))
        elif kind == "head":
            box(tag, lambda: (put(_prose(rng, rng.randrange(1, 6)), 0, rng.choice(("h1", "div", "p"))), links(rng.randrange(3), False)))
        elif kind == "foot":
            box(tag, lambda: put(rng.choice((rng.choice(FOOTERS), "© " + _prose(rng, rng.randrange(2, 30)), _told(rng, FOOTERS))), 0, rng.choice(("p", "div", "small"))))
        elif kind == "side":
            box(tag, lambda: (put(_prose(rng, rng.randrange(1, 5)), 0, rng.choice(("h2", "h3"))), links(rng.randrange(1, 5), True), put(_prose(rng, rng.randrange(3, 40)), 0, "p")))
        elif kind == "advert":
            box(tag, lambda: put(rng.choice((rng.choice(ADVERTS), _prose(rng, rng.randrange(2, 30)), _told(rng, ADVERTS))), 0, rng.choice(("p", "div", "span"))))
        elif kind == "notice":
            box(tag, lambda: put(rng.choice((rng.choice(NOTICES), _prose(rng, rng.randrange(3, 30)), _told(rng, NOTICES))), 0, rng.choice(("p", "div", "span"))))
        elif kind == "form":
            box(tag, lambda: (put(_prose(rng, rng.randrange(1, 4)), 0, "div"), put(rng.choice(("Send", "Search", "Log in")), 0, "button")))
        else:
            inner = rng.choice(("div", 'div class="comment"', "p", 'article class="comment"', "li", 'div class="reply"'))

            def comments():
                if rng.random() < 0.7:
                    put(rng.choice(("Comments", "3 replies", "Leave a reply")), 0, "h3")
                for _ in range(rng.randrange(1, 5)):
                    put(_prose(rng, rng.randrange(3, 50)), 0, inner)

            box(tag, comments)

    def article():
        if rng.random() < 0.85:
            put(_prose(rng, rng.randrange(2, 12)), 1, rng.choice(("h1", "h1", "h2")))
        n = rng.randrange(1, 9)
        inside = rng.randrange(n) if rng.random() < 0.35 else -1
        for k in range(n):
            if k == inside:
                other(rng.choice(("advert", "side", "notice", "form", "menu")))
            put(_prose(rng, rng.choice((1, 3, 10, 40, 80, 200))), 1, rng.choice(("p", "p", "p", "p", "p", "h2", "blockquote", "li", "pre", "div")))
        if rng.random() < 0.2:
            other("comments")

    html.append("<!DOCTYPE html><html><head>")
    put(_prose(rng, rng.randrange(1, 10)), 0, "title")
    html.append("<script>var a='</p>';</script><style>p{}</style></head><body>")
    wrapped = rng.random() < 0.4
    if wrapped:
        html.append(rng.choice(('<div class="page wrapper">', '<div id="container">', "<div>")))
    kinds = [k for k in ("notice", "head", "menu", "advert", "form") if rng.random() < 0.5]
    rng.shuffle(kinds)
    for kind in kinds:
        other(kind)
    box(rng.choice(ARTICLE), article)
    for kind in ("comments", "side", "advert", "form", "notice"):
        if rng.random() < 0.35:
            other(kind)
    if rng.random() < 0.8:
        other("foot")
    html.append(("</div>" if wrapped else "") + rng.choice(("</body></html>", "")))
    return "".join(html), labels
