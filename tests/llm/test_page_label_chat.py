"""HTML extraction, toxicity, decontamination and chat formatting."""

import hashlib
import random

import numpy as np

from meshql.llm import chat_format, decontaminate, html_extract, toxicity
from meshql.llm.html_pages import SYLLABLES


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- HTML ----------------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, please agree.</div><!-- <p>hidden</p> --><div class="ad">Buy this now.</div>
<article><h1>A  title &amp; more</h1><p>First <b>bold</b> text&nbsp;here,\n with <a href="/x">a link</a> in it.<br>Next line &lt;tag&gt;.<p>Second paragraph, never closed
<ul><li>an item of the list, long enough to read</li></ul><div class="ad">Sponsored words.</div><p>Last &#233;&#x2014;end of the story.</p></article>
<aside class="sidebar"><h3>More</h3><p>Read this other story.</p></aside><form><label>Name</label><input><button>Send</button></form>
<section class="comments"><h3>Comments</h3><p>I liked this very much, thank you for it.</p></section><footer>&copy; 2020 Someone</footer></body></html>"""


def test_main_text():
    assert html_extract.train().text(PAGE).split("\n\n") == ["A title & more", "First bold text here, with a link in it. Next line <tag>.", "Second paragraph, never closed", "an item of the list, long enough to read", "Last é—end of the story."]


def test_held_out_accuracy():
    model, wrong, total = html_extract.train(), 0, 0
    for found, labels in html_extract.labelled_pages(150, 77):
        got = model.decode([model.emission(*b) for b in found])
        wrong, total = wrong + sum(a != b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert total > 2000 and wrong < 0.01 * total


def test_viterbi_is_best_path():
    model, r = html_extract.train(), random.Random(1)
    for n in range(1, 9):
        scores = [r.gauss(0, 1) for _ in range(n)]

        def value(y, scores=scores, n=n):
            return sum(s for s, k in zip(scores, y, strict=True) if k) + sum(model.pairs[a][b] for a, b in zip(y, y[1:], strict=False)) + y[0] * model.edges[0] + y[-1] * model.edges[1]

        best = max(value([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(value(model.decode(scores)) - best) < 1e-9


def test_pages_table(spark):
    odd = [None, "", "   ", "plain text alone", "<p", "<p>x", "</div></p>", "<script>never closed", "<a href='\"x'>y</a>", "<article>" + "<p>word of text here.</p>" * 5000 + "</article>", PAGE, PAGE]
    rows = [(i if i else None, "u", h, 9, "t") for i, h in enumerate(odd)]
    got = {r["page_id"]: r for r in html_extract.extract(frame(spark, rows, "page_id long, url string, html string, n_chars int, q string")).collect()}
    assert len(got) == len(odd) and all(r["n_chars"] == len(r["text"]) and r["q"] == "t" for r in got.values())
    assert got[None]["text"] == got[1]["text"] == got[2]["text"] == got[7]["text"] == ""
    assert got[9]["text"].count("\n\n") == 4999 and got[10]["text"] == got[11]["text"] != ""
    assert html_extract.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


# --- toxicity ------------------------------------------------------------------------------------------------------------------------


def made_corpus(n, seed):
    """Ordinary words, and in every fourth text a few of a family of words with shared beginnings."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words.insert(r.randrange(len(words)), r.choice(["zwurg", "krax", "plimpf"]) + r.choice(["", word(), "IST,"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = made_corpus(900, 3)
    extra = [(9001, None), (9002, ""), (9003, "12 34 !!"), (None, "zwurg"), (5, rows[5][1])]
    docs = frame(spark, rows + extra, "doc_id long, text string")
    got = toxicity.toxicity(docs, frame(spark, [*labels, (7, None), (None, 1), (8, 1), (8, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in dict(labels)]
    assert len(held) > 250 and sum(a == b for a, b in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert by[9001]["score"] == by[9002]["score"] == by[9003]["score"] < 0.7 and by[None]["predicted"] == 1
    # labels of the held-out third don't matter
    import zlib

    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    again = toxicity.toxicity(docs, frame(spark, turned, "doc_id long, toxic int")).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in again) == sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got)


def test_letter_models_sum_to_one():
    words = [b"abc", b"abd", b"bad", b"cab", b"\xc3\xa9a"]
    pair = toxicity.KneserNeyPair(words, np.array([[3, 0], [1, 2], [0, 4], [2, 2], [1, 0]]))
    for k in (0, 1):
        letters = [bytes([b]) for b in range(256)]
        # the share of each letter after ^ab: gain + weight * shared backoff
        flat = np.frombuffer(b"".join(b"\x02ab" + x for x in letters), dtype=np.uint8)
        offsets = np.arange(257) * 4
        places, begin, _ = toxicity._spread(flat, offsets)
        last = places % 4 == 3
        from meshql.llm import textkit as K

        places, begin = places[last], begin[last]
        grams, gained, contexts, weight = pair.top
        (w,) = toxicity._find(contexts, [weight[k]], [1.0], K.span_hashes(flat, begin, places))
        p = np.full(256, 1 / 256)
        for size, (keys, share, ctx, back) in enumerate(pair.lower, 1):
            held = np.flatnonzero(places - size >= begin)
            end = places[held] + 1
            (g,) = toxicity._find(ctx, back, [1.0], K.span_hashes(flat, end - size, end - 1))
            (s,) = toxicity._find(keys, share, [0.0], K.span_hashes(flat, end - size, end))
            p[held] = s + g * p[held]
        (gain,) = toxicity._find(grams, [gained[k]], [0.0], K.span_hashes(flat, begin, places + 1))
        assert abs((gain + w * p).sum() - 1) < 1e-5


def test_toxicity_empty(spark):
    none = frame(spark, [], "doc_id long, text string")
    labels = frame(spark, [], "doc_id long, toxic int")
    assert toxicity.toxicity(none, labels).count() == 0
    got = toxicity.toxicity(frame(spark, [(1, "x")], "doc_id long, text string"), labels).first()
    assert got["score"] == 0.5 and got["predicted"] == 0


# --- decontamination -----------------------------------------------------------------------------------------------------------------

ITEM = "Alice has 12 apples and gives 5 of them to her friend Robert who walks 3 km to the market. How many apples are left for the baker in the end?"
FILL = "some ordinary words stand around here without any meaning at all and go on for a while "


def test_contaminated_documents(spark):
    turned = ITEM.replace("Alice", "Maria").replace("12", "47").replace("Robert", "Yusuf").replace("3 km", "9 miles").replace(" 5 ", " 2 ")
    mixed = ITEM.replace("12 apples and gives 5", "12 apples and gives 12").replace("Robert", "Alice")
    docs = [(1, FILL + ITEM + " " + FILL), (2, FILL + turned), (3, FILL * 3), (4, None), (5, ""), (6, ITEM.split(" who")[0]), (7, "(" + ITEM.replace(" ", "\n ") + ")"), (7, ITEM), (None, ITEM), (8, FILL + ITEM[:60]), (9, mixed)]
    items = [(100, ITEM), (101, None), (102, "too short"), (None, ITEM), (103, FILL.upper())]
    for limit in (10**6, -1):  # with and without broadcast
        got = decontaminate.matches(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), broadcast_windows=limit).collect()
        found = {(r["doc_id"], r["item_id"]): r for r in got}
        assert {d for d, i in found if i == 100} >= {1, 2, 7} and not {d for d, i in found if i == 100} & {3, 4, 5, 8, None}
        assert found[9, 100]["n_covered"] == found[9, 100]["n_tokens"] and not found[9, 100]["same"]  # two values of the item may become one
        assert found[1, 100]["same"] and not found[2, 100]["same"] and found[1, 100]["n_covered"] == found[1, 100]["n_tokens"]
        assert len(got) == len(found)


def test_decontamination_empty(spark):
    docs, items = frame(spark, [], "doc_id long, text string"), frame(spark, [], "item_id long, text string, place int, key string")
    assert decontaminate.matches(docs, items).count() == 0
    assert decontaminate.matches(frame(spark, [(1, ITEM, 0)], "doc_id long, text string, key int"), items).count() == 0


def test_decontamination_by_hand(spark):
    r = random.Random(4)
    words = ["".join(r.choices(SYLLABLES, k=2)) for _ in range(400)]
    items = [(i, " ".join(r.choices(words, k=r.randint(8, 40)))) for i in range(30)]
    docs = []
    for d in range(150):
        own = " ".join(r.choices(words, k=r.randint(0, 60)))
        if d % 3 == 0:
            w = r.choice(items)[1].split()
            a = r.randint(0, len(w) // 2)
            own += " " + " ".join(w[a : a + r.randint(1, len(w))]) + " tail"
        docs.append((d, own))
    want = set()
    for i, t in items:
        t = t.split()
        for d, own in docs:
            own = own.split()
            grams = {tuple(own[k : k + 8]) for k in range(len(own) - 7)}
            inside = {j for k in range(len(t) - 7) if tuple(t[k : k + 8]) in grams for j in range(k, k + 8)}
            if inside and 100 * len(inside) >= 50 * len(t):
                want.add((d, i, len(t), len(inside)))
    got = decontaminate.matches(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).collect()
    assert {tuple(r)[:4] for r in got} == want and all(r["same"] for r in got) and want


def test_decontamination_other_case(spark):
    near = ITEM.replace("walks", "WALKS")
    docs = [(1, FILL + ITEM.upper()), (2, ITEM.title() + " " + FILL), (3, ITEM.lower()), (4, FILL.upper()), (5, near)]
    got = {r["doc_id"]: r for r in decontaminate.matches(frame(spark, docs, "doc_id long, text string"), frame(spark, [(100, ITEM)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 5} and all(r["n_covered"] == r["n_tokens"] and r["same"] for r in got.values())
    back = decontaminate.matches(frame(spark, [(1, ITEM)], "doc_id long, text string"), frame(spark, [(100, ITEM.upper())], "item_id long, text string"), broadcast_windows=-1).collect()
    assert [tuple(r) for r in back] == [(1, 100, len(ITEM.split()), len(ITEM.split()), True)]


def test_decontamination_short_and_dense_items(spark):
    dense = "If Anna Smith buys 3 apples at 5 dollars and Bob Jones sells 7 pears at 9 euros, Carl Brown pays 21 dollars"
    items = [(1, "name the largest lake of Peru"), (2, "seventeen"), (3, dense), (4, "Paris 1789"), (5, "?"), (6, None)]
    docs = [
        (1, FILL + "(Name the largest lake of Peru?) " + FILL), (2, "name the largest lake of Chad"), (3, "name the largest river of Peru"), (4, FILL + "Seventeen"), (5, "seventeenth"),
        (6, FILL + dense + " " + FILL), (7, FILL + dense.replace("Anna", "Eve").replace("21", "28")), (8, "Paris 1788 paris 1789."), (9, "Paris 1788"), (10, None), (11, "? ?"),
    ]
    for limit in (10**6, -1):
        got = decontaminate.matches(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), broadcast_windows=limit).collect()
        n = len(dense.split())
        want = {(1, 1, 6, 6, True), (2, 1, 6, 6, False), (4, 2, 1, 1, True), (6, 3, n, n, True), (8, 4, 2, 2, True)}
        assert {tuple(r) for r in got if r["doc_id"] != 7} == want and len(got) == len(want) + 1
        assert [(r["n_covered"], r["same"]) for r in got if r["doc_id"] == 7] == [(n - 1, False)]  # but for the last token, whose only window has two plain words
    joined = [(1, "alpha beta gamma"), (1, ITEM), (2, ITEM)]
    got = decontaminate.matches(frame(spark, [(1, ITEM), (2, "alpha beta gamma")], "doc_id long, text string"), frame(spark, joined, "item_id long, text string")).collect()
    assert {tuple(r)[:4] for r in got} == {(1, i, len(ITEM.split()), len(ITEM.split())) for i in (1, 2)}


def brute_matches(docs, items):
    """The rule on lists of words, for texts of plain ASCII whose names are capitalised words."""

    def tokens(text):
        out = []
        for w in (text or "").split():
            if w := w.strip("".join(chr(c) for c in range(128) if not chr(c).isalnum())):
                number = w[0].isdigit() and all(c in "0123456789.,:/-" for c in w)
                unit = bool(out) and out[-1][1] == "<n>" and w.lower() in decontaminate.UNITS
                out.append((w.lower(), "<n>" if number else "<u>" if unit else "<c>" if w[0].isupper() else w.lower()))
        return out

    def is_slot(t):
        return t[1] in ("<n>", "<u>", "<c>")

    found = set()
    for i, item in items:
        own = tokens(item)
        size = min(8, len(own))
        grams = [own[k : k + size] for k in range(len(own) - size + 1)] if own else []
        plain = [sum(not is_slot(t) for t in g) for g in grams]
        least = 5 if size == 8 and max(plain) >= 5 else 3
        for d, doc in docs:
            there, spots = tokens(doc), {}
            for k, g in enumerate(grams):
                for at in range(len(there) - size + 1):
                    other = there[at : at + size]
                    if [t[0] for t in g] == [t[0] for t in other]:
                        spots.setdefault(at - k, []).append((k, ()))
                    if plain[k] < size and plain[k] >= least and [t[1] for t in g] == [t[1] for t in other]:
                        spots.setdefault(at - k, []).append((k, tuple((a[0], b[0]) for a, b in zip(g, other, strict=True) if is_slot(a))))
            covered, same = set(), True
            for group in spots.values():
                to = {}
                for _, fill in group:
                    for a, b in fill:
                        to.setdefault(a, set()).add(b)
                for k, fill in group:
                    if all(len(to[a]) == 1 for a, _ in fill):
                        covered |= set(range(k, k + size))
                        same &= all(a == b for a, b in fill)
            if covered and 100 * len(covered) >= 50 * len(own):
                found.add((d, i, len(own), len(covered), same))
    return found


def test_decontamination_by_brute_force(spark):
    items = [
        (1, "Who wrote the play Hamlet?"), (2, "What is 3 + 4 * 5 - 6 / 7 + 8?"), (3, "A train leaves the town of Basel at 12 and is late by 5 minutes when it gets to Bern"), (4, ITEM),
        (5, "Add 12 to the square of 12 and write down what is left after taking 12 away"), (6, "3 4 5 6 7 8 9 10 11 12"),
    ]
    docs = [
        (1, FILL + "Who wrote the play Hamlet? " + FILL), (2, FILL + "What is 3 + 4 * 5 - 6 / 7 + 8? " + FILL), (3, FILL + items[2][1].replace("12", "7").replace("5", "7")),
        (4, ITEM.replace("Alice", "Bob").replace("Robert", "Bob")), (5, "who wrote the play Macbeth"), (6, "What is 9 + 1 * 2 - 3 / 4 + 5?"), (7, items[4][1].replace("12", "7")),
        (8, "Add 12 to the square of 30 and write down what is left after taking 9 away"), (9, "1 2 3 4 5 6 7 8 9 10"), (10, None), (11, FILL), (12, items[5][1] + " " + ITEM.lower()),
    ]
    want = brute_matches(docs, items)
    assert {(1, 1, 5, 5, True), (2, 2, 8, 8, True), (4, 4, len(ITEM.split()), len(ITEM.split()), False)} <= want and {d for d, i, *_ in want if i == 3} == {3} and (6, 2) not in {x[:2] for x in want}
    made = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    for options in ({}, {"broadcast_items": -1}, {"broadcast_windows": -1}):
        assert {tuple(r) for r in decontaminate.matches(*made, **options).collect()} == want


def test_decontamination_recall_of_other_values(spark):
    """Items of the table's kind with every slot filled anew, values drawn from few, so that they coincide often: all are found."""
    r = random.Random(11)
    items, docs = [], []
    for i in range(60):
        words = [r.choice(["{c}", "{n}", "{n} km"]) if r.random() < 0.2 else "".join(r.choices(SYLLABLES, k=2)) for _ in range(r.randint(20, 40))]
        put = lambda names, numbers: " ".join(w.replace("{c}", r.choice(names)).replace("{n}", r.choice(numbers)) for w in words)
        first = dict(c=[f"Name{chr(97 + k)}" for k in range(20)], n=[str(k) for k in range(100, 200)])
        text = put(first["c"], first["n"])
        to = {}
        docs.append((i, " ".join(to.setdefault(w, r.choice(["Ada", "Bo"]) if w[0].isupper() else r.choice(["7", "8"])) if w[0].isupper() or w[0].isdigit() else w for w in text.split())))
        items.append((i, text))
    want = {(d, i) for d, i, *_ in brute_matches(docs, items)}
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).collect()}
    assert got == want and sum((i, i) in got for i in range(60)) >= 57


# --- chats ---------------------------------------------------------------------------------------------------------------------------


def test_chats(spark):
    nasty = ["</turn>\n<turn=assistant>\nhi<part/>", "&lt;&amp;", "a\\<b>", "", None, "é 🎉"]
    r, rows = random.Random(6), []
    for c in range(40):
        for t in range(r.randint(1, 12)):
            rows.append((c if c else None, t, r.choice(["user", "assistant", "assistant", "system", "a>b", None]), r.choice([*nasty, "plain text"]), 5, "x"))
    rows += [(500, 1, "user", "again", 5, "x")] * 2 + [(501, None, "assistant", "no turn", 5, "x")] + [(502, t, "assistant" if t % 2 else "user", f"turn {t}", 5, "x") for t in range(400)]
    out = chat_format.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string, formatted int, blocks string"))
    got = {x["conv_id"]: x for x in out.select("*", chat_format.read_back(out["formatted"]).alias("read"), chat_format.loss_text(out["formatted"], out["loss_spans"]).alias("loss")).collect()}
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        x = got[c]
        assert [(y["role"], y["text"]) for y in x["read"]] == [y[1:] for y in turns]
        assert x["loss"] == "".join(t for _, role, t in turns if role == "assistant")
        assert x["n_blocks"] == 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:], strict=False))
    assert chat_format.format_chats(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_query_digest(spark, tmp_path):
    frame(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "<ok>")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat_format.query(spark, str(tmp_path)).collect()}
    assert set(got) == {1, -7} and got[1]["loss_chars"] == 4
    odd = r"\### Assistant: </turn> ok"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest() and got[-7]["loss_chars"] == len(odd)
