"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

Blocks are the runs of text between block-level tags. Their features are the tags and the class and id words of the elements
around them, the shape of their text (size, links, punctuation, words that tell a menu from a comment), and their place: how much
text stands beside them, and what heads their group. The field is trained on labelled pages (html_pages) by gradient ascent on the
conditional likelihood, and decoded by Viterbi.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .html_pages import PageMaker
from .shared import table

#: Tags whose content isn't text of the page; tags that part blocks; tags that their own kind closes.
RAW = ("script", "style", "title", "textarea", "template", "noscript", "svg", "iframe", "select", "math", "object", "xmp")
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption button ins noframes search".split())
VOID = frozenset("hr input img meta link area base col embed param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: ... how far up an element may close others of its kind.
FENCE = frozenset("ul ol dl table div section article aside main body nav form blockquote".split())

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[\"'<>]")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

#: Words in class, id and role that tell what an element holds.
KINDS = {
    "ad": "ad ads advert advertisement adsbygoogle adbox sponsor sponsored promo promotion banner commercial anzeige werbung publicite publicidad".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy disclaimer warning toast hinweis aviso avis".split(),
    "side": "sidebar side widget related recommend recommended more share sharing social follow author bio tags trending popular teaser rail aussi relacionados verwandt".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager header masthead skip".split(),
    "form": "form newsletter subscribe signup login search register contact suche recherche".split(),
    "comments": "comment comments disqus discussion reply replies responses reader kommentar kommentare commentaire commentaires comentario comentarios".split(),
    "foot": "footer foot copyright legal bottom colophon contentinfo impressum".split(),
    "good": "article content post entry story body text main page artikel inhalt".split(),
}
WORD_KIND = {w: k for k, words in KINDS.items() for w in words}
#: Beginnings of words by which a short text tells what stands there.
CUES = {
    "comments": "comment komment coment repl antwort discuss respond".split(),
    "notice": "cookie consent gdpr privacy datenschutz privacidad".split(),
    "form": "newsletter subscri abonn suscri signup login password(?!\\s*=) email search suche regist".split(),
    "ad": "advert sponsor anzeige werbung publici promo".split(),
    "side": "related recommend popular trending share follow lire.aussi voir.aussi siehe.auch".split(),
    "foot": "copyright rights reserved impressum imprint terms".split(),
    "menu": "home menu about contact imprint".split(),
}
CUE = re.compile("|".join(rf"(?P<{k}>\b(?:{'|'.join(v)}))" for k, v in CUES.items()), re.I)
#: Elements that hold parts of different kinds side by side: the first part in them tells nothing of the others.
SHARED = frozenset(("body", "tr", "tbody", "table"))
#: A text of up to so many words may tell what it, or what follows it, is.
TELLS = 8
#: Features around a block that set it apart from the article which it may stand in.
APART = frozenset(("part-in-article", "hidden", "in:aside", "in:form", "in:nav", "in:footer", "in:menu", "in:dialog", *(f"kind:{k}" for k in KINDS if k != "good")))
CONTROLS = frozenset(("input", "button", "textarea", "select"))
PARTS = re.compile(r"[a-z]+")
#: Longest attributes whose features are kept for other elements.
KEPT_CHARS = 200
#: Words of KINDS with so many letters also stand for longer words that begin with them.
STEM = 6
STEMS = {w: k for w, k in WORD_KIND.items() if len(w) >= STEM}


def _kind(word: str) -> str:
    """The kind that a word of a name tells, or nothing."""
    return WORD_KIND.get(word) or next((STEMS[word[:n]] for n in range(len(word) - 1, STEM - 1, -1) if word[:n] in STEMS), "")


def _names(attrs: str) -> list[str]:
    found = []
    for m in NAMES.finditer(attrs):
        for name in re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower().split():
            found += PARTS.findall(name)
    return found


def _own(tag: str, attrs: str) -> frozenset[str]:
    """Features of an element by itself. Those of long attributes aren't kept, so that what is kept has a bound in bytes."""
    return _kept(tag, attrs) if len(attrs) <= KEPT_CHARS else _kept.__wrapped__(tag, attrs)


@lru_cache(maxsize=20_000)
def _kept(tag: str, attrs: str) -> frozenset[str]:
    own = {f"in:{tag}"} | {f"kind:{k}" for w in _names(attrs) if (k := _kind(w))}
    if HIDDEN.search(attrs):
        own.add("hidden")
    return frozenset(own)


@lru_cache(maxsize=50_000)
def _inside(above: frozenset[str], own: frozenset[str]) -> frozenset[str]:
    """Features that an element hands to the blocks inside it, with those of the elements above."""
    if "in:article" in above and any(f[:5] == "kind:" and f != "kind:good" for f in own):
        return above | own | {"part-in-article"}
    return above | own


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each piece of markup; comments, declarations and raw elements have no name.

    A tag ends at the first > outside quotes. One that another < cuts short, or whose quotes don't close, ends at the first > of all. Where no > is
    left there are no more tags. So every character is looked at a bounded number of times, however broken the markup is.
    """
    at, n, no_more = 0, len(html), set()
    while (i := html.find("<", at)) >= 0:
        at = i + 1
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            at = n if end < 0 else end + 3
            yield i, at, "", False, ""
            continue
        mark = html[i + 1 : i + 2]
        m = NAME.match(html, i + 1)
        if not m and mark not in ("!", "?"):
            continue
        first = html.find(">", i + 1)
        if first < 0:
            return
        if not m:
            at = first + 1
            yield i, at, "", False, ""
            continue
        name, closing, end, j = m[1].lower(), mark == "/", -1, m.end()
        while stop := STOP.search(html, j):
            c = stop[0]
            if c == ">":
                end = stop.start()
            if c in "<>" or c in no_more:
                break
            j = html.find(c, stop.end()) + 1
            if not j:
                no_more.add(c)
                break
        attrs = html[m.end() : end] if end >= 0 else ""
        at = (end if end >= 0 else first) + 1
        if name in RAW and not closing:
            over = _closing(name).search(html, at)
            at = over.end() if over else n
            yield i, at, "", False, ""
        else:
            yield i, at, name, closing, attrs


@lru_cache(maxsize=len(RAW))
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


class _Element:
    """An open element of the document, with what the blocks below it add up to."""

    __slots__ = ("tag", "around", "parent", "chars", "linked", "longest", "controls", "says", "blocks")

    def __init__(self, tag: str, around: frozenset[str], parent: _Element | None) -> None:
        self.tag, self.around, self.parent = tag, around, parent
        self.chars = self.linked = self.longest = self.controls = self.blocks = 0
        self.says = ""

    def home(self) -> _Element:
        """The element that a block inside this one shares with its siblings."""
        return self.parent or self


Block = tuple[str, frozenset[str], str, float, tuple[str, ...]]


def _group(tag: str) -> str:
    """Headings of all levels close each other; other tags close their own kind."""
    return "h" if tag[0] == "h" and tag[1:].isdigit() else tag


def blocks(html: str) -> list[Block]:
    """(text, features of the elements around, innermost tag, share of its characters in links, features of its place) of every leaf block with text."""
    root = _Element("", frozenset(), None)
    found: list[tuple[str, _Element, float]] = []
    stack, texts = [root], []
    # places in the stack of the open elements of each tag, and of those that fence others in: no search goes through the stack
    places: dict[str, list[int]] = {}
    fences = [0]
    linked, in_link, at = 0, False, 0

    def close_block() -> None:
        nonlocal linked
        if texts:
            raw = "".join(texts)
            if "&" in raw:
                raw = unescape(raw)
            text = " ".join(raw.split())
            if text:
                found.append((text, stack[-1], linked / len(raw)))
            texts.clear()
        linked = 0

    def leave(place: int) -> None:
        """Close the element at a place of the stack and all inside it."""
        for e in stack[place:]:
            places[_group(e.tag)].pop()
            if e.tag in FENCE:
                fences.pop()
        del stack[place:]

    def last(tag: str) -> int:
        return (places.get(tag) or fences[:1])[-1]

    for start, end, tag, closing, attrs in tags(html):
        if start > at:
            piece = html[at:start]
            texts.append(piece)
            if in_link:
                linked += len(piece)
        at = end
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            texts.append(" ")
        if tag in CONTROLS and not closing:
            for e in stack[-2:]:
                e.controls += 1
        if tag in BLOCK:
            close_block()
            in_link = False
            if closing:
                if place := last(_group(tag)):
                    leave(place)
            elif tag not in VOID:
                place = max(map(last, (*CLOSES.get(tag, ()), "p")))
                if place > fences[-1]:
                    leave(place)
                places.setdefault(_group(tag), []).append(len(stack))
                if tag in FENCE:
                    fences.append(len(stack))
                stack.append(_Element(tag, _inside(stack[-1].around, _own(tag, attrs if "=" in attrs else "")), stack[-1]))
    if at < len(html):
        texts.append(html[at:])
    close_block()
    return _placed(found)


def _cue(text: str) -> str:
    """What a short text tells: a kind of CUES, or nothing."""
    if text.count(" ") < TELLS and (m := CUE.search(text)):
        return m.lastgroup or ""
    return ""


def _placed(found: list[tuple[str, _Element, float]]) -> list[Block]:
    """Blocks with the features of their place: how much text stands beside them, what their neighbours and the heads of their group look like."""
    total = 1.0
    cues = [_cue(text) for text, _, _ in found]
    for (text, e, links), cue in zip(found, cues, strict=True):
        size = len(text) * (1 - links)
        total += size
        home = e.home()
        for group in {home, home.home()}:
            if not group.blocks:
                group.says = cue
            group.blocks += 1
            group.chars += size
            group.linked += len(text) * links
            group.longest = max(group.longest, size)
    out = []
    for i, ((text, e, links), cue) in enumerate(zip(found, cues, strict=True)):
        home = e.home()
        far = home.home()
        place = [
            f"home:{math.ceil(4 * home.chars / total)}", f"far:{math.ceil(4 * far.chars / total)}", f"peer:{_log_bin(int(home.longest))}", f"with-links:{math.ceil(3 * home.linked / (home.linked + home.chars + 1))}",
            f"place:{5 * i // len(found)}", f"next:{_log_bin(len(found[i + 1][0]) if i + 1 < len(found) else 0)}", f"last:{_log_bin(len(found[i - 1][0]) if i else 0)}",
        ]
        if ("in:article" in e.around or "in:main" in e.around) and not e.around & APART:
            place.append("article-proper")
        if cue:
            place.append(f"says:{cue}")
        for group in {home, far}:
            if group.parent is not None and group.says and group.tag not in SHARED:
                place.append(f"under:{group.says}")
        if e.controls or home.controls and home.parent is not None and home.tag != "body":
            place.append("controls")
        out.append((text, e.around, e.tag, links, tuple(sorted(set(place)))))
    return out


def _log_bin(n: int) -> int:
    return min(9, n.bit_length())


def shape(text: str, tag: str, links: float) -> list[str]:
    """Features of a block's own text."""
    own = [f"tag:{tag}", f"size:{_log_bin(len(text))}", f"links:{math.ceil(links * 3)}"]
    if text[-1] in ".!?…":
        own.append("ends")
    if "," in text:
        own.append("comma")
    if "©" in text[:40]:
        own.append("copyright")
    own.append(f"link-size:{math.ceil(links * 3)}:{min(6, _log_bin(len(text)))}")
    words = text.count(" ") + 1
    own.append(f"words:{_log_bin(words)}")
    own.append(f"marks:{min(4, 20 * sum(map(text.count, '.,;:!?')) // words)}")
    return own


class Crf:
    """Two labels, 1 for article text; binary features on single blocks, weights on label pairs, first and last block."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray, edges: np.ndarray) -> None:
        self.pairs, self.edges = pairs.tolist(), edges.tolist()
        self.weight = {f: float(weights[i]) for f, i in names.items()}
        self.known: dict[frozenset[str], float] = {}

    def emission(self, text: str, around: frozenset[str], tag: str, links: float, place: tuple[str, ...] = ()) -> float:
        """Score of label 1 over label 0."""
        total = self.known.get(around)
        if total is None:
            if len(self.known) > 100_000:
                self.known.clear()
            total = self.known[around] = sum(self.weight.get(f, 0.0) for f in around)
        return total + sum([self.weight.get(f, 0.0) for f in (*shape(text, tag, links), *place)]) + self.weight["bias"]

    def decode(self, scores: list[float]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not scores:
            return []
        (oo, on), (no, nn) = self.pairs
        a, b = 0.0, self.edges[0] + scores[0]
        back = []
        for s in scores[1:]:
            stay, come = a + oo, b + no
            leave, keep = a + on, b + nn
            back.append((come > stay, keep > leave))
            a, b = max(stay, come), max(leave, keep) + s
        label = int(b + self.edges[1] > a)
        out = [label]
        for to_out, to_in in reversed(back):
            label = int(to_in if label else to_out)
            out.append(label)
        return out[::-1]

    def text(self, html: str) -> str:
        found = blocks(html)
        labels = self.decode([self.emission(*b) for b in found])
        return "\n\n".join([b[0] for b, y in zip(found, labels, strict=True) if y])


def labelled_pages(number: int, seed: int) -> list[tuple[list[tuple], list[int]]]:
    """Blocks and labels of made pages. A piece's label holds for the blocks that it adds to the page."""
    out = []
    for i in range(number):
        pieces = PageMaker(seed * 1_000_003 + i).page()
        # each text of a piece gets the mark, so that blocks tell their piece after parsing
        html = "".join((f"\x01{y}\x01" * (p[:1] not in ("<", "")) + re.sub(r">(?=\s*[^<\s])", f">\x01{y}\x01", p)) if y >= 0 else p for p, y in pieces)
        labels = []
        for text, *_ in blocks(html):
            mark = re.search(r"\x01([01])\x01", text)
            if re.sub(r"\x01[01]\x01", "", text).strip():
                labels.append(int(mark[1]) if mark else 0)
        found = blocks(re.sub(r"\x01[01]\x01", "", html))
        if found and len(found) == len(labels):
            out.append((found, labels))
    return out


@cache
def train(pages: int = 3000, seed: int = 1, steps: int = 250, ridge: float = 3e-4) -> Crf:
    """Fit on made pages by Adam on the mean log-likelihood, all pages at once; takes some twenty seconds and no data of the corpus."""
    data = labelled_pages(pages, seed)
    names: dict[str, int] = {"bias": 0}
    rows = [[[0, *(names.setdefault(f, len(names)) for f in (*sorted(a), *shape(t, g, k), *c))] for t, a, g, k, c in found] for found, _ in data]
    n, longest = len(data), max(len(r) for r in rows)
    # (block, feature) pairs; a block's place is that in the table of all pages by blocks
    cell = np.array([i * longest + t for i, own in enumerate(rows) for t, fs in enumerate(own) for _ in fs])
    feature = np.array([f for own in rows for fs in own for f in fs])
    y, mask = np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=bool)
    for i, (own, (_, labels)) in enumerate(zip(rows, data, strict=True)):
        y[i, : len(own)], mask[i, : len(own)] = labels, True
    last = mask.sum(axis=1) - 1
    w, pairs, edges = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    theta = [w, pairs, edges]
    m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    every = np.arange(n)
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(cell, w[feature], n * longest).reshape(n, longest)
        e[:, 0, 1] += edges[0]
        e[every, last, 1] += edges[1]
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(mask[:, t, None], np.logaddexp(fwd[:, t - 1, :1] + pairs[0], fwd[:, t - 1, 1:] + pairs[1]) + e[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = bwd[:, t + 1] + e[:, t + 1]
            bwd[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(nxt[:, :1] + pairs[:, 0], nxt[:, 1:] + pairs[:, 1]), 0)
        z = np.logaddexp(fwd[every, last, 0], fwd[every, last, 1])
        p = np.where(mask, np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]), 0)
        off = np.where(mask, y - p, 0)
        both = mask[:, 1:]
        joint = np.exp(fwd[:, :-1, :, None] + pairs + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
        grads = [
            np.bincount(feature, off.ravel()[cell], len(names)) / n - ridge * w,
            (seen - joint.sum(axis=(0, 1))) / n - ridge * pairs,
            np.array([off[:, 0].sum(), off[every, last].sum()]) / n - ridge * edges,
        ]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            theta[i] += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Crf(names, w, pairs, edges)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """All columns of pages but html, and text string, n_chars long (code points of text).

    Null and empty html, and pages without article text, have an empty text. Markup may be broken: unclosed elements end with
    their container or the page, stray end tags are left out, and time stays in proportion to the page (see tags). Very long pages are worked
    through whole, one at a time. Rows are independent: repeated rows and null keys are kept. Columns
    named text or n_chars are replaced. No rows give no rows.
    """
    from pyspark.sql.types import StructType

    model = model or train()
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = StructType([*pages.select(*[f"`{c}`" for c in keep]).schema.fields, *StructType.fromDDL("text string, n_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(h.as_py() or "").encode("utf-8", "replace").decode() for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*[f"`{c}`" for c in keep], "html").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
