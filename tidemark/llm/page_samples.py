"""Labelled sample pages, made from a seed, that the extraction model is fitted on.

Layouts, element names, attribute tokens and lengths vary; words are invented. Elements that hold main text
carry ``data-k="1"``, insertions into it ``data-k="0"``; the features never see that attribute.
"""

from __future__ import annotations

import random

from tidemark.llm.dom import MARK

_SYLLABLES = "an be ca do el fi gu ha in jo ki lo ma ne or pa qui ra se ti un ve wo xe ya zu éa ñi öl ßen ch str".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low=4, high=18) -> str:
        parts = self.words(low, high).split()
        return " ".join(w + ("," if self.r.random() < 0.07 else "") for w in parts).capitalize() + "."

    def prose(self, low=1, high=7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def tag(self, options: list[str], inside: str, k: str | None = None) -> str:
        """``options``: names, or names with a class (div.x) or an id (div#x)."""
        name = self.r.choice(options)
        at = f' {MARK}="{k}"' if k else ""
        if "." in name:
            name, c = name.split(".", 1)
            at += f' class="{c}"'
        elif "#" in name:
            name, c = name.split("#", 1)
            at += f' id="{c}"'
        return f"<{name}{at}>{inside}</{name}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, self.r.choice((1, 3, 8)))}</a>' for _ in range(self.r.randint(low, high))]
        how = self.r.randrange(3)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if how else (" | ".join(items) if self.r.random() < 0.5 else "".join(items))

    def nav(self) -> str:
        return self.tag(["nav", "nav", "nav.navbar", "div.menu", "div#nav", "div.breadcrumbs", "ul.menu", "div.navigation", "div"], self.links(3, 12))

    def ad(self) -> str:
        inside = self.r.choice([self.prose(1, 3), self.sentence(3, 12), f'<a href="/x">{self.sentence(3, 9)}</a>', f"<p>{self.prose(1, 2)}</p>"])
        return self.tag(["div.ad", "div.ad", "div.ads", "div.advert", "div.sponsored", "div.promo", "aside.ad", "div#ad-top", "section.promo", "p.ad"], inside, "0")

    def notice(self) -> str:
        inside = self.r.choice([f"<p>{self.prose(1, 3)}</p><button>{self.word()}</button>", self.prose(1, 2), f"{self.sentence()}<a href='/p'>{self.word()}</a>"])
        return self.tag(["div.cookie-notice", "div.notice", "div.alert", "div#consent", "div.gdpr", "div.popup", "section.cookie", "p.notice"], inside, "0")

    def form(self) -> str:
        return self.tag(["form", "form.search", "form.newsletter", "div.newsletter", "form#signup", "div.subscribe"], f"<label>{self.words(1, 6)}</label><p>{self.sentence()}</p><input name='q'><button>{self.word()}</button>", "0")

    def share(self) -> str:
        return self.tag(["div.share", "ul.social", "div.related", "section.related", "div.tags", "div.recommended"], f"<h3>{self.words(1, 3)}</h3>" * self.r.randrange(2) + self.links(2, 6), "0")

    def side(self) -> str:
        parts = [self.r.choice([lambda: f"<h3>{self.words(1, 4)}</h3>{self.links(3, 9)}", lambda: f"<p>{self.prose(1, 4)}</p>", self.form, self.ad])() for _ in range(self.r.randint(1, 4))]
        return self.tag(["aside", "aside.sidebar", "div.sidebar", "div#sidebar", "div.side", "div#secondary", "div.widget"], "".join(parts))

    def comments(self) -> str:
        one = self.r.choice(["li.comment", "div.comment", "article.comment", "div.reply"])
        items = "".join(self.tag([one], f"<b>{self.word()}</b>" * self.r.randrange(2) + f"<p>{self.prose(1, 5)}</p>" * self.r.randint(1, 2)) for _ in range(self.r.randint(1, 6)))
        inside = f"<h3>{self.words(1, 3)}</h3>" * self.r.randrange(2) + (f"<ol>{items}</ol>" if one.startswith("li") else items) + (self.form() if self.r.random() < 0.5 else "")
        return self.tag(["section.comments", "div#comments", "div.comments", "section#comments", "div.discussion", "div#respond"], inside, "0")

    def head(self) -> str:
        inside = f"<a href='/'>{self.words(1, 3)}</a>" + (f"<p>{self.words(2, 8)}</p>" if self.r.random() < 0.5 else "") + (self.nav() if self.r.random() < 0.4 else "")
        return self.tag(["header", "header.site-header", "div#header", "div.header", "div.masthead", "div.topbar"], inside, "0")

    def foot(self) -> str:
        inside = self.r.choice([f"&copy; {self.word()} &middot; {self.prose(1, 3)}", f"<p>{self.prose(1, 4)}</p>", self.links(2, 8) + f"<p>{self.words(2, 9)}</p>", f"<div>{self.links(3, 9)}</div>{self.sentence()}"])
        return self.tag(["footer", "footer", "footer.site-footer", "div#footer", "div.footer", "div.copyright"], inside, "0")

    def block(self) -> str:
        r = self.r.random()
        inline = f"<b>{self.word()}</b> " if self.r.random() < 0.2 else f'<a href="/l">{self.words(1, 3)}</a> ' if self.r.random() < 0.2 else ""
        if r < 0.66:
            return f"<p>{inline}{self.prose(1, self.r.choice((1, 3, 8, 14)))}</p>"
        if r < 0.74:
            return f"<h{self.r.choice('223')}>{self.words(1, 8)}</h{self.r.choice('223')}>"
        if r < 0.80:
            return f"<p><b>{self.sentence()}<br>"
        if r < 0.86:
            return self.tag(["ul", "ol"], "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(self.r.randint(2, 6))))
        if r < 0.90:
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if r < 0.93:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(self.r.randint(2, 5))) + "</table>"
        if r < 0.95:
            return f"<figure><img src='i'><figcaption>{self.sentence()}</figcaption></figure>"
        if r < 0.97:
            return f"<pre>{self.words(5, 30)}</pre>"
        return f"<div>{self.prose(1, 5)}</div>"

    def main(self) -> str:
        blocks = [f"<h1>{self.words(2, 10)}</h1>"] if self.r.random() < 0.8 else []
        if blocks and self.r.random() < 0.2:
            blocks = [f"<header>{blocks[0]}</header>"]
        for _ in range(self.r.choice((1, 1, 2, 3, 5, 9, 15, 25))):
            blocks.append(self.block())
            if self.r.random() < 0.07:
                blocks.append(self.r.choice([self.ad, self.share, self.form, self.side, self.notice])().replace("<aside", f'<aside {MARK}="0"', 1))
        if self.r.random() < 0.3:
            blocks.append(self.share())
        if self.r.random() < 0.15:
            blocks.append(self.comments())
        inside = "".join(blocks)
        if self.r.random() < 0.3:
            inside = self.tag(["div.entry-content", "div.body", "section", "div", "div.text", "div.post-body"], inside)
        return self.tag(["article", "article", "article", "article.post", "main", "div.content", "div#content", "div.post", "div.entry", "section.story", "div.article-body", "div#main", "div"], inside, "1")

    def page(self) -> str:
        r = self.r.random
        middle = [self.main()]
        for part, p in ((self.ad, 0.5), (self.comments, 0.4), (self.side, 0.45), (self.notice, 0.3), (self.share, 0.2), (self.form, 0.15)):
            if r() < p:
                (middle.insert(0, part()) if r() < 0.5 else middle.append(part()))
        body = "".join(middle)
        if r() < 0.35:
            body = self.tag(["div#page", "div.container", "div#wrapper", "main", "div", "div#content"], body)
        body = (self.head() if r() < 0.5 else "") + (self.nav() if r() < 0.7 else "") + body + (self.foot() if r() < 0.8 else "")
        if r() < 0.3:
            body = self.tag(["div.site", "div#root", "div", "div#page"], body)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{body}" + "</body></html>" * (r() < 0.9)


def sample_pages(count: int, seed: int) -> list[str]:
    return [_Maker(seed * 1_000_003 + i).page() for i in range(count)]
