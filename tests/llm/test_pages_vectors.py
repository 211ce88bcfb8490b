"""NN-descent, WARC and HTML extraction: against brute force and on odd rows."""

import base64
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import entry as llm
from loomspan.llm import html, vectors, warc

SF = "/root/testdata/sf0.001"


def brute_vectors(rows, threshold=0.98):
    """{vec_id: (links, component)} by all pairs."""
    # scaled first, so that squares of very large components stay finite
    usable = {k: np.array(v, float) / np.abs(v).max() for k, v, label in rows if v and label is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    label = {k: x for k, _, x in rows}
    link = {k: set() for k, _, _ in rows}
    for a, x in usable.items():
        for b, y in usable.items():
            if a < b and label[a] == label[b] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                link[a].add(b)
                link[b].add(a)
    out = {}
    for start in sorted(link):
        todo = [start]
        while todo:
            k = todo.pop()
            if k not in out:
                out[k] = (len(link[k]), start)
                todo += link[k]
    return out


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for size in (1, 1, 1, 2, 3, 40, 150):
        base = rng.normal(size=16)
        for _ in range(size):
            rows.append((k, (base + rng.normal(size=16) * 0.05).tolist(), k % 2 if size < 40 else 1))
            k += 1
    rows += [(k + j, rng.normal(size=16).tolist(), 0) for j in range(200)]
    k += 200
    rows += [(k + j, rows[60][1], 1) for j in range(50)]  # exact copies
    k += 50
    rows += [(k, None, 1), (k + 1, [0.0] * 16, 1), (k + 2, [float("nan")] * 16, 1), (k + 3, [None] + [1.0] * 15, 1), (k + 4, [1.0] * 16, None), (k + 5, [1.0] * 16, None), (k + 6, [], 1), (k + 7, [2.0] * 3, 1), (k + 8, [1e300] * 3, 1), (k + 9, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit(1)).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, k=4).collect()}
    assert got == brute_vectors(rows)


def test_vectors_odd(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, schema)).collect()))
    assert [(g[0], g[2]) for g in got] == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1)]


def test_vectors_recall_at_scale(spark):
    """Labels of several thousand vectors, so that cells split: groups of near copies of every size, pairs near the threshold,
    a group with a core and a rim that is too large for one block, exact copies, and vectors alone. All links are found."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows = []
    for label, alone in ((0, 6000), (1, 3000)):
        made = [unit(rng.normal(size=(alone, 32)))]
        for size in [2] * 150 + [3] * 40 + [12] * 10 + [60] * 3:
            base = unit(rng.normal(size=32))
            made.append(unit(base + rng.normal(size=(size, 32)) * rng.choice([0.005, 0.015, 0.024])))
        made += [made[1]] * 30
        if label == 0:
            base = unit(rng.normal(size=32))
            made += [unit(base + rng.normal(size=(2600, 32)) * 0.008), unit(base + rng.normal(size=(150, 32)) * 0.03)]
        m = np.concatenate(made)
        rows += [(m[k], label) for k in range(len(m))]
    order = rng.permutation(len(rows))
    rows = [(k, rows[at][0].tolist(), rows[at][1]) for k, at in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    for label in (0, 1):
        ids = np.array([k for k, _, x in rows if x == label])
        m = np.array([v for _, v, x in rows if x == label])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        linked = m @ m.T >= 0.98
        links = linked.sum(1) - 1
        found = np.array([got[k][0] for k in ids])
        assert (found <= links).all() and found.sum() >= 0.999 * links.sum() and (found[links > 0] / links[links > 0]).mean() > 0.99
        whole = vectors._forest(linked)
        assert np.mean([got[k][1] == ids[r] for k, r in zip(ids, whole, strict=True)]) > 0.999


def test_vectors_audit_sees_missed_pairs(spark):
    """One large group that is found whole doesn't hide that all small pairs were missed."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=32)
    vecs = [base + rng.normal(size=32) * 0.01 for _ in range(150)]
    for _ in range(10):
        x = rng.normal(size=32)
        vecs += [x, x + rng.normal(size=32) * 0.01]
    reps = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(vecs)], "space long, uid long, vector array<double>")
    found = spark.createDataFrame([(k, 0) for k in range(150)], "node long, component long")
    assert vectors.audit(reps, found, 0.98) == 0
    whole = found.unionAll(spark.createDataFrame([(k, k - k % 2) for k in range(150, 170)], found.schema))
    assert vectors.audit(reps, whole, 0.98) == 1


def test_vectors_fail_loudly(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TURNS", 1, raising=False)
    monkeypatch.setattr(vectors, "audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="0.5"):
        vectors.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, label int"))


def test_vectors_saturated_lists_grow(spark, monkeypatch):
    """Two groups of more than k close copies, joined by one pair above the threshold that no cell holds."""
    monkeypatch.setattr(vectors, "audit", lambda *_: 1.0)
    angle = np.r_[np.arange(14) * -0.01, np.arccos(0.981) + np.arange(14) * 0.01]
    rows = [(k, [float(np.cos(x)), float(np.sin(x))], 1) for k, x in enumerate(angle)]
    cell = [(a, b, float(np.cos(angle[a] - angle[b]))) for a in range(28) for b in range(28) if a != b and {a, b} != {0, 14}]
    monkeypatch.setattr(vectors, "_cells", lambda *_: spark.createDataFrame(cell, vectors._PAIRS))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, k=4).collect()}
    assert got == brute_vectors(rows) and {c for _, c in got.values()} == {0}


def test_vectors_rounds_end_by_convergence(spark, monkeypatch):
    """Every round finds the next link of a chain; the last one counts too."""
    turn = iter(range(1, 9))

    def refine(*_):
        k = next(turn)
        return spark.createDataFrame([(k, k + 1, 0.99)] if k < 7 else [], vectors._PAIRS)

    monkeypatch.setattr(vectors, "audit", lambda *_: 1.0)
    monkeypatch.setattr(vectors, "_cells", lambda *_: spark.createDataFrame([(0, 1, 0.99)], vectors._PAIRS))
    monkeypatch.setattr(vectors, "_refine", refine)
    rows = [(k, [float(np.cos(0.15 * k)), float(np.sin(0.15 * k))], 1) for k in range(8)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.component_id for r in got} == dict.fromkeys(range(8), 0)


# WARC

@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://x.example/{k}", "é" * (300 + 400 * (k % 3)) + str(k % 4)) for k in range(40)]
    rows += [(100, None, None), (101, "u\r\nX-Evil: 1", ""), (102, "a", "y" * 1000), (103, "a", "y" * 1000), (103, "a", "y" * 1000), (None, "n", "y" * 1000), (104, "a", "z" * 999), (105, "a", "z" * 999)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


def test_warc_round_trip(pages):
    rows = [(r.page_id, r.url, (r.html or "").encode()) for r in pages.collect()]
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    body = {k: b for k, _, b in rows}
    top = {b: max(k for k, _, x in rows if x == b and k is not None) for _, _, b in rows}
    for r in got:
        b = body[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        again = len(b) >= 1000 and r.page_id != top[b]
        assert (r.record_type, r.refers_to) == (("revisit", top[b]) if again else ("response", None))


def test_warc_pushdown_and_foreign_files(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.write(pages, path)
    every = warc.read(spark, path)
    some = every.where("record_type = 'revisit' and page_id in (0, 1, 102)")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "= revisit" not in plan and {r.page_id for r in some.collect()} <= {0, 1, 102}
    assert every.where("record_type = 'response'").agg(F.sum(F.length("payload"))).first()[0] == every.where("record_type = 'response'").agg(F.sum("declared_bytes")).first()[0]
    assert warc.read(spark, path, "none").where("payload_bytes is not null").count() == 0
    other = tmp_path / "b"
    other.mkdir()
    make = lambda k, size: warc.record("response", k, "u", "00" * 20, size, None, "d", os.urandom(size // 2).hex().encode())
    (other / "a.warc").write_bytes(b"".join(make(k, 5000) for k in range(7)))
    (other / "b.warc.gz").write_bytes(b"".join(gzip.compress(make(k, 300_000)) for k in range(5)))
    for kind in ("bytes", "digest", "none"):
        assert warc.read(spark, str(other), kind).count() == 12
    assert warc.read(spark, str(other)).where("page_id = 3").agg(F.sum("payload_bytes")).first()[0] == 305_000


def test_warc_headers_of_foreign_files():
    plain = hashlib.sha1(b"x").digest()
    block = lambda digest, more="": f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}".encode()
    for text in (base64.b32encode(plain).decode(), base64.b32encode(plain).decode().lower(), plain.hex(), plain.hex().upper()):
        assert warc._headers(block(text))["declared_digest"] == plain.hex()
    assert warc._headers(block("1" * 32))["declared_digest"] == "1" * 32
    row = warc._headers(block("", "X-Page-Id: x7\r\nContent-Length: many\r\n"))
    assert (row["page_id"], row["length"], row["declared_digest"]) == (None, 0, None)


def test_warc_nulls_in_lists(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.write(pages, path)
    every = warc.read(spark, path, "none")
    for test in ("page_id in (0, null, 100)", "page_id = 0 or page_id = 100", "url in ('n', null)", "page_id = null"):
        want = {r.record_id for r in every.collect() if {"page_id in (0, null, 100)": r.page_id in (0, 100), "page_id = 0 or page_id = 100": r.page_id in (0, 100), "url in ('n', null)": r.url == "n", "page_id = null": False}[test]}
        assert {r.record_id for r in every.where(test).collect()} == want


def test_warc_files_of_several_ranges(spark, tmp_path):
    """A file larger than a range is read in parts, and no record twice."""
    path = str(tmp_path / "big")
    rng = np.random.default_rng(3)
    rows = [(k, f"u{k}", rng.bytes(300_000).hex()) for k in range(70)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(df, path)
    back = warc.read(spark, path, "digest")
    assert back.rdd.getNumPartitions() > 1
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in back.collect()} == {k: (len(h), hashlib.sha1(h.encode()).hexdigest()) for k, _, h in rows}
    assert back.count() == 70 and [r.page_id for r in back.where("page_id = 66").collect()] == [66]


def test_warc_empty(spark, pages, tmp_path):
    assert warc.round_trip(pages.limit(0)).count() == 0


# HTML

def test_article_text():
    page = """<html><body class="has-sidebar"><header><h2>Site</h2></header><nav><a href=/>x</a></nav><div class="cookie-notice"><p>We use cookies</p></div>
    <article><h1>The&nbsp; title</h1><p>First <b>bold</b> &lt;para&gt;<br>graph.<p>Be.<div class="ad">Buy now</div><aside>Side</aside><form><p>Sign up</p><input></form>
    <script>if (a < b) document.write("</p>")</script><style>p > a {}</style><!-- note > here --><p title="a > b">Last one &amp; done</p>
    <section id="comments"><p>Great post!</p></section></article><footer>&copy; site</footer></body></html>"""
    assert html.main_text(page) == "The title\nFirst bold <para> graph.\nBe.\nLast one & done"


def test_page_without_article():
    long = "The cat is on the mat and it was in the house of the man who was there with a dog that is not from here but they have been to the place. " * 2
    page = f"<body><div id=menu><a href=/>Home</a> <a href=/b>Blog</a></div><div><h2>A heading</h2><p>{long}</p><p>Short one.</p><p>{long}</p></div><p><a href=/x>More links here</a></p></body>"
    assert html.main_text(page).split("\n") == ["A heading", long.strip(), "Short one.", long.strip()]


ITALIAN = "Questa è una prova della lingua italiana che contiene molte parole di uso comune e non è presente in alcuna lista; di certo la frase è lunga e la lettura di essa non è difficile per chi conosce la lingua. "


def test_page_in_another_language():
    page = f"<body><header><h1>Site name</h1><p>Tagline of the site</p></header><div class=menu><a href=/>Home</a></div><p>{ITALIAN}</p><p>{ITALIAN[10:]}</p><p>Il gatto e la volpe. {ITALIAN}</p><footer>x</footer></body>"
    assert html.main_text(page).split("\n") == [ITALIAN.strip(), ITALIAN[10:].strip(), f"Il gatto e la volpe. {ITALIAN}".strip()]


def test_names_inside_the_article():
    page = "<article><p class=legal>A b c</p><p class='related-work'>d e f</p><section class='side-effects'><p>g h i</p></section><ul><li>one<li class='share'>two<li>three</ul><a href=/x/>link</a> end<div class='cookie-notice'>We use</div><div class=adSlot>Buy</div><table><tr><td>1<td>2<tr><td>3</table><header><p>Kept</p></header></article>"
    assert html.main_text(page).split("\n") == ["A b c", "d e f", "g h i", "one", "two", "three", "link end", "1", "2", "3", "Kept"]


def test_menus_inside_the_article():
    item = "<li><a href=/x>Some page</a></li>"
    assert html.main_text(f"<article><p>Text</p><ul>{item * 3}</ul><p><a href=/y>One link</a></p></article>") == "Text"
    assert html.main_text(f"<article><p>Text</p><ul>{item * 2}</ul><p>More</p></article>") == "Text\nSome page\nSome page\nMore"


def test_generated_pages():
    """Pages made of known parts: the article's blocks come back, and nothing else."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeéoßñ"), rng.integers(1, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    junk = [
        lambda: f"<nav><ul><li><a href='/{word()}'>{say(2)}</a><li><a href=/x/>{say(1)}</a></ul></nav>", lambda: f"<div class='{rng.choice(['ad', 'ad-slot-3', 'cookie-notice', 'site-menu', 'relatedPosts'])}'><p>{say(30)}</p></div>",
        lambda: f"<aside><h3>{say(2)}</h3><p>{say(20)}</aside>", lambda: f"<form><p>{say(3)}</p><input value='>'><button>Ok</button></form>", lambda: f"<script>var x = '<p>{say(3)}</p>';</script><style>p > a {{}}</style>",
        lambda: f"<!-- {say(4)} <p> -->", lambda: f"<section id=comments><article class=comment><p>{say(40)}</p></article></section>", lambda: f"<footer><p>&copy; {say(9)}</p></footer>", lambda: f"<div style='display: none'>{say(5)}</div>",
    ]
    for _ in range(200):
        want, body = [], []
        for _ in range(rng.integers(1, 9)):
            if rng.random() < 0.4:
                body.append(rng.choice(junk)())
            words = [word() for _ in range(rng.integers(1, 60))]
            want.append(" ".join(words) + " & <x>")
            shown = " ".join(f"<{t}>{w}</{t}>" if (t := rng.choice(["", "b", "i", "span", "code"])) and rng.random() < 0.2 else w for w in words).replace(" ", "&nbsp;\n", 1) + " &amp; &lt;x&gt;"
            kind = rng.choice(["p", "h2", "li", "blockquote", "div", "td"])
            own = "" if rng.random() < 0.7 else " class='legal'" if kind in ("p", "h2") else f" class={word()}"
            text = f"<{kind}{own}>{shown}" + (f"</{kind}>" if kind not in ("p", "li", "td") or rng.random() < 0.5 else "")
            body.append(f"<ul>{text}</ul>" if kind == "li" else f"<table><tr>{text}</table>" if kind == "td" else text)
        around = [rng.choice(junk)() for _ in range(rng.integers(0, 4))]
        page = f"<html><body><header><h2>{say(2)}</h2><p>{say(30)}</p></header>{''.join(around)}<article>{''.join(body)}</article>{''.join(around)}</body>"
        assert html.main_text(page).split("\n") == want, page


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<", "a < b & c", "<article>" * 3000 + "x", "<p title='" + "a" * 100_000, "<!-- never closed", "<script>x", "&#0;&#xD800;&bogus;", "<div " * 20_000])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


def test_html_query(spark):
    got = llm.op10_html_text(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.where("n_chars <> length(text) or n_chars = 0").count() == 0
    empty = spark.createDataFrame([(None, None, None, "x")], "page_id long, url string, html string, text string")
    assert html.extract(empty).first().n_chars == 0 and html.extract(empty.limit(0)).count() == 0
