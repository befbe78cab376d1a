"""Main text of pages written by hand, in layouts and with names that the made training pages don't have; and time on broken markup."""

import os
import time
from html.parser import HTMLParser

import pytest

from meshql.llm import html_extract

#: name: (html, beginnings of the article's blocks)
PAGES = {
    "bare": (
        "<html><body><div><a href='/'>Home</a> <a href='/a'>About us</a> <a href='/c'>Contact</a></div><div><h1>How bridges are built</h1>"
        "<p>Engineers begin with the ground, and they drill for weeks before any plan is drawn.</p><p>Then the piers are set, and the deck follows in long sections that are lifted by cranes.</p>"
        "<p>At the end the road is laid, and the bridge opens.</p></div><div>© 2020 Bridge News. All rights reserved.</div></body></html>",
        ["How bridges", "Engineers begin", "Then the piers", "At the end"],
    ),
    "hashed": (
        "<div class='x1a'><div class='k9'><a href=1>News</a></div><div class='k9'><a href=2>Sports</a></div></div><div class='qq7'><h1>The town fair</h1>"
        "<p>Every summer the town opens its square to farmers, who bring their fruit, cheese and bread.</p><p>This year the fair lasted for three days, and the mayor gave a speech.</p></div>"
        "<div class='zz1'><h3>Comments</h3><div class='c0'><p>I was there with my children and we loved it a lot.</p></div><div class='c0'><p>Too many people for me this time.</p></div></div>"
        "<div class='n3'><p>Subscribe to our newsletter</p><input type=text><button>Send</button></div>",
        ["The town fair", "Every summer", "This year"],
    ),
    "kommentare": (
        "<header><a href='/'>Start</a></header><main><h1>Das Wetter</h1><p>Am Montag regnet es im Norden, im Süden bleibt es trocken und warm.</p>"
        "<p>Am Dienstag wird es kühler, und der Wind nimmt zu.</p></main><div class='kommentare'><p>Endlich mal wieder Regen, das freut meinen Garten sehr.</p></div><footer>Impressum</footer>",
        ["Das Wetter", "Am Montag", "Am Dienstag"],
    ),
    "tables": (
        "<table><tr><td class='left'><a href=a>One</a><br><a href=b>Two</a><br><a href=c>Three</a></td><td><h2>Old machines</h2><p>The first engines were slow, loud and heavy, and they broke down every other day.</p>"
        "<p>Later ones ran for a year without any repair, which changed the work of the mills.</p></td></tr></table><p align=center>Copyright 1999 The Museum</p>",
        ["Old machines", "The first engines", "Later ones"],
    ),
    "reply": (
        "<nav><ul><li><a href=/>Blog</a></li></ul></nav><div class='entry'><h1>Bread at home</h1><p>Mix the flour, the water and the salt, and leave the dough alone for a night.</p><ul><li>500 g of flour, sieved</li><li>a spoon of salt</li></ul>"
        "<p>Bake it in a hot oven until the crust is dark.</p></div><ol class='commentlist'><li>Mine came out flat, what did I do wrong here?</li><li>Try a warmer room.</li></ol><form><textarea></textarea><button>Post</button></form>",
        ["Bread at home", "Mix the flour", "500 g of flour", "a spoon of salt", "Bake it in"],
    ),
    "notice": (
        "<div id='consent-box'>We use cookies to make this site better. <button>Accept</button></div><article><h1>Night trains</h1><p>After years of decline the sleeping cars are back on the long lines of the continent.</p>"
        "<div class='advert'>Book cheap hotels now.</div><p>Tickets sell out weeks before, so that more trains were ordered.</p></article><aside><h4>Popular now</h4><ul><li><a href=1>Ten best beaches</a></li><li><a href=2>What to pack</a></li></ul></aside>",
        ["Night trains", "After years", "Tickets sell"],
    ),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_hand_labelled_page(name):
    html, want = PAGES[name]
    got = html_extract.train().text(html).split("\n\n")
    assert len(got) == len(want) and all(g.startswith(w) for g, w in zip(got, want, strict=True)), got


@pytest.mark.parametrize("unit", ["<a ", '<a href="', "<a x\">\"", "<script ", "<!-- ", "<p", "<a '\">", "<a \"'>", "<div>", "</", "<", "<a b='\"<i \"'>", "<title></title ", "&", "<x y=\"'\" ", "<center>", "<ul><li>", "</center>", "<p></li>", "<h1></h2>", "<table><td>"])
def test_broken_markup_takes_linear_time(unit):
    model, html = html_extract.train(), unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    model.text(html)
    model.text(html + ">")
    assert time.perf_counter() - began < 6  # two runs of 1 MB


@pytest.mark.parametrize(("open_", "close"), [("<div>", "</p>"), ("<ul>", "</li>"), ("<center>", "</b>"), ("<li>", "</h1>"), ("<section>", "</section>")])
def test_deep_pages_take_linear_time(open_, close):
    n = 1_000_000 // len(open_ + close)
    began = time.perf_counter()
    html_extract.train().text(open_ * n + "x" + close * n)
    assert time.perf_counter() - began < 3


def test_long_attributes_are_not_kept():
    before = html_extract._kept.cache_info().currsize
    html_extract.blocks("".join(f"<div class='menu' data-props='{i}{'x' * 5000}'>text</div>" for i in range(50)))
    assert html_extract._kept.cache_info().currsize == before
    assert "kind:menu" in html_extract.blocks(f"<div data-props='{'x' * 5000}' class=menu>text</div>")[0][1]


#: Pages without an element for the article, lists of links as articles, parts told by a short text alone.
OTHERS = [
    ("It was a dark night, and the rain fell on the roofs of the town without an end in sight.", ["It was a dark"]),
    ("<body>It was a dark night, and the rain fell on the roofs of the town.</body>", ["It was a dark"]),
    ("<article><h1>Ten books</h1><ol>" + "".join(f"<li><a href=/{i}>The long road to the city number {i}, a novel.</a></li>" for i in range(6)) + "</ol></article>", ["Ten books", *["The long road"] * 6]),
    ("<table><tr><td>Menu</td><td><h1>Title of it</h1><p>The first engines were slow, loud and heavy, and they broke down every other day.</p></td></tr></table>", ["Title of it", "The first engines"]),
    ("<article><h1>Titre</h1><p>Il faisait nuit, et la pluie tombait sur les toits de la ville.</p><div class=voir-aussi>Lire aussi : <a href=1>Autre chose</a></div><p>Le matin vint enfin, et les rues se remplirent.</p></article>", ["Titre", "Il faisait", "Le matin"]),
]


@pytest.mark.parametrize("at", range(len(OTHERS)))
def test_other_layouts(at):
    html, want = OTHERS[at]
    got = html_extract.train().text(html).split("\n\n")
    assert len(got) == len(want) and all(g.startswith(w) for g, w in zip(got, want, strict=True)), got


class Article(HTMLParser):
    """The plain reading of the given pages, whose main text is what stands in <article>: blocks parted by the tags in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in html_extract.BLOCK:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in html_extract.BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_given_pages(spark):
    for r in html_extract.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        plain = Article()
        plain.feed(r["html"] or "")
        plain.close()
        want = "\n\n".join(t for b in plain.blocks if (t := " ".join(b.split())))
        assert (r["text"], r["n_chars"]) == (want, len(want)), r["page_id"]


def test_tags_end_where_they_should():
    assert [(n, c, a) for *_, n, c, a in html_extract.tags("<p a='>' b=\">\">x</p ><BR/>1 < 2 <<i>y<a <b>")] == [("p", False, " a='>' b=\">\""), ("p", True, " "), ("br", False, "/"), ("i", False, ""), ("a", False, "")]


def test_caches_are_bounded():
    model = html_extract.train()
    for k in range(3):
        model.text("".join(f"<div id='e{k}-{i}' class='c{k * 40_000 + i}'><p>word of text</p></div>" for i in range(20_000)))
    assert html_extract._kept.cache_info().currsize <= 20_000 and html_extract._inside.cache_info().currsize <= 50_000 and len(model.known) <= 100_001
