"""Labelled training pages made by rule: many layouts of articles among menus, notices, adverts, forms, sidebars and comments."""

from __future__ import annotations

import random

#: Wrappers that sites use around parts that aren't the article, as (tag, class or id) by kind.
AROUND = {
    "menu": [("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("ul", "navbar"), ("div", "breadcrumbs"), ("div", "nav-links"), ("header", "site-header"), ("header", ""), ("td", "left"), ("td", ""), ("div", "topbar"), ("menu", "")],
    "ad": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "sponsored"), ("td", "ads"), ("div", "ad-banner"), ("ins", "adsbygoogle"), ("section", "promo"), ("div", "advertisement"), ("p", "sponsor")],
    "notice": [("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "consent"), ("div", "notice"), ("div", "gdpr"), ("dialog", "popup"), ("div", "alert"), ("section", "privacy-notice"), ("div", "banner")],
    "side": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("div", "widget"), ("section", "recommended"), ("div", "more-stories"), ("div", "share"), ("div", "social"), ("div", "author-bio"), ("div", "tags")],
    "form": [("form", ""), ("form", "newsletter"), ("form", "search"), ("div", "subscribe"), ("form", "login"), ("fieldset", "")],
    "comments": [("section", "comments"), ("div", "comments"), ("ol", "comment-list"), ("div", "reader-comments"), ("div", "disqus_thread"), ("div", "responses")],
    "foot": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "legal"), ("div", "bottom")],
}
MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("section", "entry-content"), ("div", "article-body"), ("div", "story"), ("div", ""), ("div", "page"), ("td", "text")]
#: Kinds before, inside and after the article.
BEFORE, INSIDE, AFTER = ("menu", "notice", "ad", "form", "side"), ("ad", "side", "form", "notice"), ("comments", "side", "ad", "form", "notice", "menu", "foot")

#: Short texts by which readers tell such parts, in some languages.
HEADS = {
    "menu": ["Home", "About us", "Contact", "Menu"],
    "ad": ["Advertisement", "Sponsored", "Anzeige", "Werbung", "Promoted", "Publicidad"],
    "notice": ["We use cookies", "Cookie settings", "Privacy notice", "Datenschutz"],
    "side": ["Related", "Popular now", "Share this", "Recommended for you", "Trending", "Follow us", "Lire aussi :", "Voir aussi", "Siehe auch"],
    "form": ["Newsletter", "Subscribe now", "Sign up by email", "Search", "Login", "Abonnieren"],
    "comments": ["Comments", "3 comments", "Leave a reply", "Kommentare", "Commentaires", "Comentarios", "Discussion", "12 replies"],
    "foot": ["All rights reserved", "Terms", "Impressum", "Copyright 2021", "Imprint"],
}
#: Shares of made pages whose elements have no names, and such as tell nothing; the others have names of AROUND and MAIN.
BARE, HASHED = 0.3, 0.2
#: Share of pages without any element for the article, of blocks of an article that are lists of links, and of those that another part follows.
PLAIN, LINKED, INSERTED = 0.04, 0.008, 0.16
SEMANTIC = frozenset("nav header footer aside article main section menu dialog".split())

SYLLABLES = "ba be bi bo da de di do fa fe ga go ha he ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to un en ar or".split()


class PageMaker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        kind = self.r.random()
        self.names = "none" if kind < BARE else "hashed" if kind < BARE + HASHED else "plain"
        self.plain_tags = self.names != "plain" and self.r.random() < 0.8

    def element(self, tag: str, name: str) -> tuple[str, str]:
        """Tag and attributes of a wrapper as this page writes them."""
        if self.plain_tags and tag in SEMANTIC or self.names == "none" and tag == "ins":
            tag = "div"
        if self.names == "none":
            return tag, ""
        if self.names == "hashed":
            return tag, f' class="{"".join(self.r.choices("abcdefghijkmnpqrstuvwxyz0123456789", k=6))}"'
        return tag, f' {self.r.choice(["class", "class", "id"])}="{name}"' if name else ""

    def head(self, kind: str, tag: str = "") -> str:
        """Mostly, where nothing else tells the part, a short text that does."""
        text = self.r.choice(HEADS[kind])
        shown = self.r.random() < (0.15 if self.names == "plain" else 0.85)
        return (f"<{tag}>{text}</{tag}>" if tag else text + " ") if shown else ""

    def words(self, low: int, high: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            w = "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))
            out.append(w + r.choice(["", "", "", "", ",", "."]))
        return " ".join(out).capitalize()

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).rstrip(",.") + self.r.choice([".", ".", ".", "", "?", "!"])

    def wrap(self, where: tuple[str, str], inner: str) -> str:
        tag, attrs = self.element(*where)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, inner_tag: str) -> str:
        r = self.r
        return "".join(f'<{inner_tag}><a href="/{i}">{self.words(1, 4)}</a></{inner_tag}>' for i in range(r.choice([1, 2, 3, 4, 5, 6, 7, 9])))

    def block(self) -> str:
        """One block of article text, or a list, a table, a quotation of some."""
        r = self.r
        kind = r.random()
        if kind < 0.72:
            body = self.sentence(*r.choice([(1, 4), (5, 20), (20, 80), (60, 160)]))
            body = r.choice([body, f"<b>{body}", f'{body} <a href="/x">{self.words(1, 3)}</a>', f"<em>{self.words(1, 2)}</em> {body}"])
            return r.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}<br>", f"<div>{body}</div>", f"<p>{body}"])
        if kind < 0.82:
            return f"<h{r.randint(2, 4)}>{self.words(1, 8)}</h{2}>"
        if kind < 0.88:
            return f"<blockquote>{self.sentence(5, 40)}</blockquote>"
        if kind < 0.94:
            return "<ul>" + "".join(f"<li>{self.sentence(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<pre>{self.words(2, 20)}</pre>"

    def other(self, kind: str) -> str:
        r, where = self.r, self.r.choice(AROUND[kind])
        head = r.choice(["h2", "h3", "h4", "p", "div"])
        if kind == "menu":
            several = "<br>".join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randint(1, 6)))
            return self.wrap(where, r.choice([f"<ul>{self.links('li')}</ul>", self.links("span"), self.links("div"), several, self.head(kind) or several]))
        if kind == "form":
            return self.wrap(where, self.head(kind, r.choice(["", head])) + f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button>" + r.choice(["", f"<p>{self.sentence(3, 20)}</p>"]))
        if kind == "comments":
            first = self.head(kind, head) or r.choice(["", f"<h3>{self.words(1, 3)}</h3>"] if self.names == "plain" else [f"<h3>{r.choice(HEADS[kind])}</h3>"])
            return self.wrap(where, first + "".join(r.choice(["<{0}{1}>{2}</{0}>", "<li>{2}</li>", "<p>{2}</p>"]).format(*self.element("div", "comment"), self.sentence(2, 60)) for _ in range(r.randint(1, 6))))
        if kind == "foot":
            return self.wrap(where, r.choice(["&copy; ", "&copy; 2020 ", "" if self.names == "plain" else "&copy; "]) + self.head(kind) + self.sentence(1, 15) + r.choice(["", f"<ul>{self.links('li')}</ul>"]))
        inner = r.choice([self.head(kind) + self.sentence(2, 25), self.head(kind, head) + f"<p>{self.sentence(2, 40)}</p>", f"<p>{self.head(kind)}{self.sentence(2, 15)}</p>", self.head(kind, head) + f"<h4>{self.words(1, 4)}</h4><p>{self.sentence(3, 40)}</p>"])
        return self.wrap(where, r.choice([inner, inner, f"{self.head(kind, head)}<ul>{self.links('li')}</ul>"]) if kind == "side" else inner)

    def plain(self) -> list[tuple[str, int]]:
        """A page that is one run of text, or lines of it, without any element for the article."""
        r = self.r
        body = r.choice(["\n", "<br>", "<br><br>", "\n\n"]).join(self.sentence(*r.choice([(4, 20), (15, 80)])) for _ in range(r.choice([1, 1, 2, 4])))
        return [(r.choice(["", "<body>", "<html><head><title>x</title></head><body>", "<html><body>"]), -1), (body, 1)]

    def link_list(self) -> str:
        """A list of links that is a part of the article: longer texts than a menu's."""
        r = self.r
        tag = r.choice(["ol", "ul", "ol"])
        return f"<{tag}>" + "".join(f'<li><a href="/{i}">{self.sentence(*r.choice([(3, 8), (5, 15), (8, 25)]))}</a></li>' for i in range(r.randint(2, 9))) + f"</{tag}>"

    def page(self) -> list[tuple[str, int]]:
        """Pieces of html in page order, each with its label: 1 for article text. Wrappers that hold pieces have label -1."""
        if self.r.random() < PLAIN:
            return self.plain()
        r, out = self.r, [("<html><head><title>x</title></head><body>", -1)]
        framed = self.names != "plain" and r.random() < 0.2  # a table for the layout
        if framed:
            out.append(("<table><tr><td>", -1))
        for kind in r.sample(BEFORE, r.randint(0, len(BEFORE))):
            out.append((self.other(kind), 0))
        if framed:
            out.append(("</td><td>", -1))
        tag, attrs = self.element(*r.choice(MAIN))
        out.append((f"<{tag}{attrs}>", -1))
        if r.random() < 0.8:
            out.append((f"<h1>{self.words(1, 12)}</h1>", 1))
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            out.append((self.link_list() if r.random() < LINKED else self.block(), 1))
            if r.random() < INSERTED:
                out.append((self.other(r.choice(INSIDE)), 0))
        if r.random() < 0.15:
            out.append((self.other("comments"), 0))
        out.append((f"</{tag}>", -1))
        for kind in r.sample(AFTER, r.randint(0, len(AFTER))):
            out.append((self.other(kind), 0))
        if framed:
            out.append(("</td></tr></table>", -1))
        return [*out, ("</body></html>", -1)]
