"""Labelled pages to train the page model on: many layouts, each with its true main text.

Invented words in invented layouts; nothing is taken from a corpus. The pages are
a pure function of their number.
"""

from __future__ import annotations

import html
import random

from pyspark.sql import DataFrame, SparkSession

PAGES = 600
_SYLLABLES = "ba be bi bo bu ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu ra re ri ro ru sa se si so su ta te ti to tu an en in on er ar or".split()


class _Page:
    def __init__(self, number: int) -> None:
        self.r = random.Random(number * 7919 + 17)
        self.true: list[str] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(w + ("," if r.random() < 0.08 else ". " if r.random() < 0.05 else "") for w in out)
        text = " ".join(text.split())
        return text[:1].upper() + text[1:] + r.choice((".", ".", ".", "", "?", "!", " & more."))

    def links(self, low: int, high: int, attrs: str = "") -> str:
        return "".join(f'<li{attrs}><a href="/{i}">{html.escape(self.words(1, 3))}</a></li>' for i in range(self.r.randint(low, high)))

    def content(self, tag: str, low: int, high: int) -> str:
        """A true block, maybe with inline markup."""
        text = self.words(low, high)
        self.true.append(text)
        at, r = text.split(" "), self.r
        shown = [html.escape(w) for w in at]
        if len(at) > 4 and r.random() < 0.3:
            i = r.randrange(len(at) - 2)
            inline = r.choice(("b", "i", "em", "strong", "span", 'a href="/x"'))
            shown[i] = f"<{inline}>{shown[i]}"
            shown[i + 1] += f"</{inline.split()[0]}>"
        gap = r.choice((" ", " ", " ", "\n  "))
        start = r.choice(("", "", "", "<b>")) if tag == "p" else ""
        end = r.choice((f"</{tag}>",) * 6 + ("<br>",)) if tag == "p" else f"</{tag}>"
        return f"<{tag}>{start}{gap.join(shown)}{end}"

    def noise(self) -> str:
        """A block inside or around the article that is no content."""
        r, w = self.r, self.words
        return r.choice((
            lambda: f'<div class="{r.choice(("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored"))}">{w(2, 30)}</div>',
            lambda: f'<aside class="{r.choice(("ad", "related", "promo", "sidebar", "widget"))}"><p>{w(3, 25)}</p></aside>',
            lambda: f'<div class="{r.choice(("share", "social", "breadcrumb", "tags", "pagination", "meta", "byline"))}"><ul>{self.links(2, 5)}</ul></div>',
            lambda: f'<form class="{r.choice(("newsletter", "search", "subscribe", "login"))}"><label>{w(2, 6)}</label><input name="q"><button>{w(1, 2)}</button></form>',
            lambda: f'<div class="{r.choice(("notice", "cookie-notice", "cookie", "consent", "alert", "warning", "popup", "modal"))}"><p>{w(5, 40)}</p><button>{w(1, 2)}</button></div>',
            lambda: f'<div class="{r.choice(("related", "recommended", "more-stories"))}"><h3>{w(2, 4)}</h3><ul>{self.links(3, 6)}</ul></div>',
        ))()

    def comments(self) -> str:
        r = self.r
        outer, inner = r.choice((('section id="comments"', 'div class="comment"'), ('div class="comments"', 'div class="comment"'), ('ol class="comment-list"', "li"), ('div id="respond" class="comments-area"', 'article class="comment"'), ('section class="reader-comments"', 'div class="reply"'), ('ul class="comments"', 'li class="comment"')))
        items = "".join(f"<{inner}><p>{self.words(3, 60)}</p></{inner.split()[0]}>" for _ in range(r.randint(1, 6)))
        head = f"<h2>{self.words(1, 3)}</h2>" if r.random() < 0.5 and not outer.startswith(("ol", "ul")) else ""
        return f"<{outer}>{head}{items}</{outer.split()[0]}>"

    def article(self) -> str:
        r, body = self.r, []
        if r.random() < 0.85:
            body.append(self.content("h1", 2, 12))
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 15))):
            kind = r.random()
            if kind < 0.78:
                body.append(self.content("p", *r.choice(((1, 5), (5, 30), (20, 90), (60, 200)))))
            elif kind < 0.86:
                body.append(self.content(r.choice(("h2", "h3")), 1, 7))
            elif kind < 0.90:
                body.append("<ul>" + "".join(self.content("li", 2, 20) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.93:
                body.append("<blockquote>" + self.content("p", 5, 40) + "</blockquote>")
            elif kind < 0.95:
                body.append("<table><tr>" + "".join(self.content("td", 1, 5) for _ in range(3)) + "</tr></table>")
            elif kind < 0.97:
                body.append("<figure><img src=x>" + self.content("figcaption", 3, 12) + "</figure>")
            else:
                body.append(self.content("pre", 3, 20))
            if r.random() < 0.08:
                body.append(self.noise())
        outer = r.choice(("article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'div id="main" role="main"', 'section class="story"'))
        inside = f"<{outer}>" + "\n".join(body)
        if r.random() < 0.2:
            inside += self.comments()
        inside += f"</{outer.split()[0]}>"
        for _ in range(r.choice((0, 0, 1))):
            wrap = r.choice(("div", 'div class="container"', "main", 'div id="page"', 'div class="wrap"'))
            inside = f"<{wrap}>{inside}</{wrap.split()[0]}>"
        return inside

    def page(self) -> str:
        r, w = self.r, self.words
        head = f'<!DOCTYPE html><html lang="{r.choice(("en", "de", "fr"))}"><head><meta charset="utf-8"><title>{w(2, 10)}</title>'
        head += r.choice(("", "<style>p{margin:0}</style>")) + r.choice(("", '<script>var t="</p>";track(1);</script>')) + "</head><body>"
        before = []
        if r.random() < 0.6:
            before.append(f'<nav><ul>{self.links(2, 9)}</ul></nav>' if r.random() < 0.7 else f'<div class="{r.choice(("menu", "nav", "navbar", "navigation", "topbar"))}"><ul>{self.links(2, 9)}</ul></div>')
        if r.random() < 0.4:
            before.append(f'<header{r.choice(("", " class=site-header"))}><a href="/">{w(1, 3)}</a><p>{w(2, 12)}</p></header>' if r.random() < 0.7 else f'<div id="header" class="masthead">{w(1, 8)}</div>')
        before += [self.noise() for _ in range(r.choice((0, 1, 1, 2)))]
        if r.random() < 0.3:
            before.append(f"<!-- {w(1, 3)} -->")
        r.shuffle(before)
        article, after = self.article(), []
        if r.random() < 0.3:
            after.append(self.comments())
        if r.random() < 0.3:
            after.append(f'<{r.choice(("aside", "aside class=sidebar"))}><h3>{w(1, 3)}</h3><ul>{self.links(2, 6)}</ul><p>{w(3, 25)}</p></aside>' if r.random() < 0.6 else f'<div class="{r.choice(("sidebar", "widget", "sidebar-right"))}"><h3>{w(1, 3)}</h3><p>{w(3, 40)}</p></div>')
        after += [self.noise() for _ in range(r.choice((0, 0, 1, 2)))]
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(f"<footer>&copy; {w(1, 3)} &middot; {w(2, 30)}</footer>" if r.random() < 0.7 else f'<div class="footer" id="footer"><p>{w(3, 30)}</p></div>')
        end = r.choice(("</body></html>",) * 8 + ("",))
        return head + "".join(before) + article + "".join(after) + end


def labelled_page(number: int) -> tuple[str, str]:
    """(html, true main text)"""
    p = _Page(number)
    page = p.page()
    return page, "\n".join(" ".join(x.split()) for x in p.true)


def labelled_pages(spark: SparkSession, pages: int = PAGES) -> DataFrame:
    """html, text: built inside the tasks."""

    def run(frames):
        for frame in frames:
            made = [labelled_page(int(i)) for i in frame["id"]]
            frame["html"], frame["text"] = [m[0] for m in made], [m[1] for m in made]
            yield frame[["html", "text"]]

    return spark.range(0, pages, 1, 4).mapInPandas(run, "html string, text string")
