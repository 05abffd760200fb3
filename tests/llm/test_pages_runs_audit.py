"""Main text, periodic runs and the filter audit against brute force, with nulls, empty and long texts, ties and odd columns."""

import html
import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import permutations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fleetgauge.llm import extraction, filter_audit, periodic_runs
from fleetgauge.llm.queries import QUERIES, with_repeats

# --- main text ---------------------------------------------------------------

PAGES = {
    # Menus, a marked advert, entities, an unclosed <b>, a break, a script inside a paragraph, a footer in the article.
    '<!DOCTYPE html><html><head><title>T &amp; more</title><style>p{margin:0}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>'
    '<div class="ad">Buy now, this is a long advert text.</div><article><h1>T &amp; more &am</h1><p><b>One  two\n three<br>four</p><p>a<script>var x="</p>";</script>b</p>'
    '<p>Short.</p><footer>Shared by</footer></article><footer>&copy; site</footer></body></html>': "T & more &am\nOne two three four\nab\nShort.",
    # Reader comments longer than the article, each an article of its own; a related teaser.
    '<main><article><h1>Title</h1><p>Few words.</p><section id="comments"><article><p>' + "A very long comment by a reader. " * 20
    + '</p></article></section></article><aside><article><p>' + "A teaser. " * 50 + "</p></article></aside></main>": "Title\nFew words.",
    # No article element: the stretch around the text, with the heading above it and short lines in it.
    '<body><div id="header"><a>Site</a></div><div class="has-sidebar"><div class="content"><h1>Head</h1><p>' + "This is a long paragraph of text. " * 4
    + '</p><p>Brief.</p><div class="cookie-notice">We use cookies</div><p>' + "Here is another long one, with words. " * 4 + '</p><p>End.</p></div>'
    '<div class="sidebar"><p>About us</p><ul><li><a>x</a><li><a>y</a></ul></div></div><form><label>Name</label><input><button>Send</button></form></body>':
        "Head\n" + ("This is a long paragraph of text. " * 4).strip() + "\nBrief.\n" + ("Here is another long one, with words. " * 4).strip() + "\nEnd.",
    # A form around the page, as some frameworks make it; a menu that was never closed.
    "<form id=f><nav><a>Menu</a></nav><article><h1>A</h1><p>b c d e f g</p></article></form>": "A\nb c d e f g",
    "<nav><a>Menu</a><article><h1>Whole</h1><p>" + "words " * 30 + "</p></article>": "Whole\n" + ("words " * 30).strip(),
    # Lists and tables are read cell by cell; marked inline elements and comments are left out.
    "<article><p>one</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><p>two<span class=share>tweet</span> three<!-- x --></p></article>": "one\na\nb\n1\n2\ntwo three",
    "<article><header><h1>Kept</h1></header><p>a &lt; b &#233;&nbsp;c</p></article><header>gone</header>": "Kept\na < b é c",
    # Cut off within a tag, a comment, a script; nothing but a menu; no markup; none at all.
    "<article><p>a b</p> c <a hre": "a b\nc", "<article><p>a b</p> <!-- x <p>c</p>": "a b", "<article><p>a</p><script>var <p>c": "a",
    "<nav>Menu</nav>": "", "plain  text": "plain text", "": "", " \n ": "",
}


def test_main_text_of_pages():
    for page, text in PAGES.items():
        assert extraction.main_text(page) == text, page


def test_main_text_of_the_given_pages(spark):
    """Their articles hold paragraphs and headings only, so cutting at these tags gives the text as well."""
    given = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = {r.page_id: r for r in QUERIES["op11_ratio_extraction"](spark, SMALL).collect()}
    assert set(found) == set(given)
    for key, page in given.items():
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        text = "\n".join(filter(None, blocks))
        assert (found[key].text, found[key].n_chars) == (text, len(text))


def test_pages_as_rows(spark):
    rows = [(1, "u", p) for p in PAGES] + [(2, None, None), (None, "v", "<p>x</p>"), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")}).repartition(3)
    got = extraction.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(k, u, "x" if p == "<p>x</p>" else PAGES[p or ""]) for k, u, p in rows]
    assert Counter(tuple(r) for r in got.collect()) == Counter((k, u, t, len(t)) for k, u, t in want)
    assert extraction.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>a" * 30000, "<b>a</div>" * 30000, "<" * 100000, "<!--" * 50000, "<a " * 50000, "</a " * 50000, "<article>a" * 20000,
                                  '<p class="ad"><span class=ad>a' * 10000, "<li>" * 30000, "&" * 100000])
def test_long_odd_pages_take_linear_time(page):
    extraction.main_text(page)


# --- periodic runs -----------------------------------------------------------

def naive_runs(w, shortest, periods):
    found = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(shortest, periods * q) and not any(
                    all(w[x] == w[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                found.append((i, length, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k = rng.choice((1, 2, 2, 3, 5))
    words = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(50))]
    for _ in range(rng.randrange(3)):
        unit = [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 7))]
        at = rng.randint(0, len(words))
        words[at:at] = unit * rng.randint(2, 7) + unit[:rng.randrange(len(unit))]
    return words


@pytest.mark.parametrize("shortest, periods", [(6, 4), (2, 2), (6, 2), (4, 3), (1, 5)])
def test_runs_against_brute_force(shortest, periods):
    rng = random.Random(shortest * 10 + periods)
    for _ in range(800):
        texts = [random_words(rng) for _ in range(3)]
        want = [naive_runs(w, shortest, periods) for w in texts]
        assert [periodic_runs.runs([int(x[1:]) for x in w], shortest, periods) for w in texts] == want
        # Stretches are found over several texts at once, and runs do not reach from one to the next.
        found, kept = periodic_runs.collapse([rng.choice((" ", "\n\t ")).join(w).encode() + b" \x0b" for w in texts], shortest, periods)
        assert found == want
        drop = [{i for a, n, q in runs for i in range(a + q, a + n)} for runs in want]
        assert kept == [" ".join(x for i, x in enumerate(w) if i not in d).encode() for w, d in zip(texts, drop)]


def test_long_runs():
    assert periodic_runs.runs([7] * 20000) == [(0, 20000, 1)]
    unit = list(range(3000))
    assert periodic_runs.runs([-1, *unit * 4, 5]) == [(1, 12000, 3000)]
    found, kept = periodic_runs.collapse([b" ".join(b"x%d" % x for x in unit * 5)])
    assert found == [[(0, 15000, 3000)]] and kept[0].split() == [b"x%d" % x for x in unit]


def planted(key, words):
    h = zlib.crc32(str(key).encode()) if key is not None else 0
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_of_documents(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice((" ", "\n", "\t")).join(random_words(rng))) for i in range(300)]
    rows += [(i, " ".join(f"word{rng.randrange(400)}" for _ in range(rng.randrange(900)))) for i in range(300, 400)]
    rows += [(500, None), (501, ""), (502, " \n "), (None, "a b c"), (None, "x " * 9), rows[0], rows[0], (503, "é " * 7 + "\x1c \xa0 end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "start": F.lit("x"), "_words": F.lit(0)}).repartition(3)
    want = Counter()
    for key, text in rows:
        words = planted(key, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        runs = naive_runs(words, 6, 4)
        drop = {i for a, n, q in runs for i in range(a + q, a + n)}
        want[key, tuple(runs), " ".join(w for i, w in enumerate(words) if i not in drop)] += 1
    got = periodic_runs.find(with_repeats(frame)).collect()
    assert Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == want
    assert periodic_runs.find(with_repeats(frame.limit(0))).count() == 0


def test_digest_of_runs(spark):
    """The query's columns over the small tables, from the runs by brute force."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text or "") < 20000}
    found = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    some = 0
    for key, text in texts.items():
        words = planted(key, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        if len(words) > 1200:
            continue
        runs = naive_runs(words, 6, 4)
        some += bool(runs)
        best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
        row = found[key]
        assert row.n_runs == len(runs) and (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert row.runs_sha256 == sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        drop = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert row.collapsed_sha256 == sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
    assert some > 5


# --- filter audit ------------------------------------------------------------

def naive_audit(rows, labels):
    """Every order applied to every document."""
    def fails(key, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows)}
    docs = [(lang or "", {f for f, bad in fails(key, text or "").items() if bad}, any(k == key and q == 1 for k, q, _ in labels if key is not None),
             any(k == key and x == 1 for k, _, x in labels if key is not None)) for key, text, lang in rows]
    out, total = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                every = [d for d in docs if d[0] == part and f in d[1]]
                total[part, f] += len(removed)
                out[part, order, step] = [len(left), len(removed), len(every) - len(removed), sum(d[1] == {f} for d in every),
                                          sum(d[2] for d in removed), sum(d[3] for d in removed)]
    return {(part, order, step): (*values, total[part, order[step - 1]]) for (part, order, step), values in out.items()}


def test_audit_against_every_order(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice(("word", "Word", "UP", "é$", "x%d" % rng.randrange(300))) for _ in range(rng.choice((0, 3, 99, 100, 140)))) for _ in range(12)]
    base += [" ".join(f"v{i}" for i in range(n)) for n in (100, 120, 150)] + ["A" + "b" * 8, "A" + "b" * 9, "\n \t", ""]
    rows = [(rng.randrange(60), rng.choice(base), rng.choice(("en", "de", None, ""))) for _ in range(120)]
    rows += [(None, base[0], "en"), (None, None, None), (70, None, "en"), rows[0], rows[0], (rows[1][0], rows[1][1], "fr")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, 2))) for k in [*range(0, 60, 2), 4, 4, None, 999]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"mask": F.lit("x"), "part": F.lit(1), "sum": F.lit(2)}).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(frame, marks).collect()}
    assert got == naive_audit(rows, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert {r.good_lost for r in filter_audit.audit(frame, marks.limit(0)).collect()} == {0}


def test_shapley_weights_are_those_of_the_orders():
    for n in (1, 2, 3, 5):
        rows = filter_audit.shapley_weights(n)
        for i, row in enumerate(rows):
            counts = Counter()
            for order in permutations(range(n)):
                before = sum(1 << x for x in order[:order.index(i)])
                counts[before | 1 << i] += 1
                counts[before] -= 1
            assert [counts[c] for c in range(1, 2**n)] == list(row[1:])


def test_audit_takes_other_filters(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "bb", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(rows, labels, {"L": F.length("text") > 1}, repeated="R").collect()
    assert {(r.filter_order, r.step, r.kept, r.removed, r.good_lost, r.shapley) for r in got} == {
        ("LR", 1, 2, 1, 1, 2), ("LR", 2, 1, 1, 0, 2), ("RL", 1, 2, 1, 0, 2), ("RL", 2, 1, 1, 1, 2)}
