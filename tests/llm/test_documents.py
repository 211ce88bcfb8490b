"""PII, quality, substring dedup, n-gram Jaccard join, decontamination, language, mixing: against brute force and on odd rows."""

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import common, decontaminate, fmindex, jaccard, langid, mixing, oracles, pii, quality, rtree, substrings
from loomspan.llm import entry as llm
from loomspan.llm import words as words_module
from loomspan.llm.words import mix
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, component_id long, h string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names clash."""
    long = " ".join(f"w{k % 900}" for k in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, long, "en", "b"), (4, long, "en", "b"), (None, "one two three four five six", "fr", None), (6, "one two three", None, "b"), (7, "ONE two  THREE", "en", "b"), (8, "é" * 50, "fr", "ü"), (9, "1234 !!", "en", "a")]
    return spark.createDataFrame([(*r, 0, 0.5, 7, 9, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize(("name", "sql"), [("op3_nn_descent", oracles.VECTORS), ("op4_substring_dedup", oracles.SUBSTRINGS), ("op5_ngram_jaccard", oracles.JACCARD), ("op8_warc_round_trip", oracles.WARC)])
def test_queries_agree_with_sql(spark, name, sql):
    assert_same(llm.queries()[name](spark, SF), connect(SF), sql)


# PII

def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pii_round_trip_and_formats(spark):
    text = 'card 4845168114407329 or 4845-1681-1440-7329, +1 (417) 555-7713, 97.51.17.173, für.34@mail.example.com token = "04dbebab91ab85687d33" 2020-02-29 31.12.1999 123-45-6789 GB82 WEST 1234 5698 7654 32 but 1234567890123456 300.1.1.1'
    df = spark.createDataFrame([(1, text), (2, "call 4845168114407329 now"), (3, None), (4, ""), (5, "x" * 300_000 + "@" + "9" * 40)], "doc_id long, text string")
    out = pii.pseudonymise(df, "k", counter="n")
    got = {r.doc_id: r for r in out.collect()}
    new = got[1].text
    card = re.search(r"card (\d{16}) or ([\d-]{19})", new)
    assert card[1] != "4845168114407329" and luhn(card[1]) and card[2].replace("-", "") == card[1] and card[1] in got[2].text
    assert got[1].n == 10 and "1234567890123456 300.1.1.1" in new and "@mail.example.com" in new and "für.34" not in new
    iban = re.search(r"GB\d\d WEST [\d ]+\d", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert (got[3].text, got[3].n, got[4].text) == (None, 0, "")
    back = {r.doc_id: r.text for r in pii.pseudonymise(out, "k", back=True).collect()}
    assert back == {r.doc_id: r.text for r in df.collect()}
    assert pii.pseudonymise(df, "other").where("doc_id = 1").first().text != new


def naive_feistel(a, b, size_a, size_b, tweak, key, back=False):
    """Ten rounds over Z_a x Z_b, keyed by SHA-256."""
    prf = lambda i, x: int(sha256(f"{key}:{tweak}:{i}:{x}".encode()).hexdigest()[:15], 16)
    for i in reversed(range(10)) if back else range(10):
        size = size_a if i % 2 == 0 else size_b
        a, b = ((b - prf(i, a)) % size, a) if back else (b, (a + prf(i, b)) % size)
    return a, b


def naive_value(m, key, back=False):
    """The pseudonym of a date, address, phone number, card or social security number by the definition."""
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        x, g, n = map(int, m.split("-"))
        if not (0 < x < 900 and x != 666 and g and n):
            return m
        areas = [k for k in range(1, 900) if k != 666]
        x, y = naive_feistel(areas.index(x), (g - 1) * 9999 + n - 1, 898, 99 * 9999, "ssn", key, back)
        return f"{areas[x]:03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        kinds = {1: range(10), 2: range(10, 100), 3: range(100, 256)}
        o, k = [int(x) for x in m.split(".")], [kinds[len(x)] for x in m.split(".")]
        if any(x not in r for x, r in zip(o, k, strict=True)):
            return m
        i = [r.index(x) for x, r in zip(o, k, strict=True)]
        n = list(map(len, k))
        x, y = naive_feistel(i[0] * n[1] + i[1], i[2] * n[3] + i[3], n[0] * n[1], n[2] * n[3], "ip", key, back)
        return ".".join(str(r[v]) for r, v in zip(k, (x // n[1], x % n[1], y // n[3], y % n[3]), strict=True))
    if re.fullmatch(r"\d{4}([-/.])\d\d\1\d\d|\d{1,2}([/.])\d{1,2}\2\d{4}", m):
        sep = re.search(r"\D", m)[0]
        p = m.split(sep)
        order = (0, 1, 2) if len(p[0]) == 4 else (2, 1, 0) if sep == "." or int(p[0]) > 12 else (2, 0, 1)
        y, mo, d = (p[k] for k in order)
        try:
            date(2000, int(mo), int(d))
            date(int(y), int(mo), int(d))
        except ValueError:
            return m
        if not 1800 <= int(y) < 2200:
            return m
        leap = [k for k in range(1800, 2200) if k % 4 == 0 and (k % 100 or k % 400 == 0)]
        if (int(mo), int(d)) == (2, 29):
            by = int(sha256(f"{key}:leap:0:0".encode()).hexdigest()[:15], 16) * (-1 if back else 1)
            new = (leap[(leap.index(int(y)) + by) % 97], 2, 29)
        else:
            late = order == (2, 1, 0) and sep == "/"
            days = [(x.month, x.day) for x in (date(2001, 1, 1) + timedelta(k) for k in range(365)) if x.month < 10 ** len(mo) and x.day < 10 ** len(d) and (not late or x.day > 12)]
            a, b = naive_feistel(int(y) - 1800, days.index((int(mo), int(d))), 400, len(days), "date", key, back)
            new = (a + 1800, *days[b])
        out = [None] * 3
        for k, v, like in zip(order, new, (y, mo, d), strict=True):
            out[k] = str(v).zfill(len(like))
        return sep.join(out)
    digits = re.sub(r"\D", "", m)
    if m.startswith(("+", "(")) or len(digits) == 10:
        code, own = digits[:-10], digits[-10:]
        if code in ("", "1"):
            codes = [k for k in range(200, 1000) if k % 100 != 11]
            if int(own[:3]) not in codes or int(own[3:6]) not in codes:
                return m
            x, y = naive_feistel(codes.index(int(own[:3])), codes.index(int(own[3:6])) * 10000 + int(own[6:]), 792, 7920000, "phone", key, back)
            new = f"{codes[x]}{codes[y // 10000]}{y % 10000:04}"
        elif code[0] in "01" or own[0] == "0":
            return m
        else:
            x, y = naive_feistel(int(own[:5]) - 10000, int(own[5:]), 90000, 100000, "abroad", key, back)
            new = f"{x + 10000}{y:05}"
        new = iter(code + new)
    else:
        brand = digits[0] == "4" and len(digits) in (13, 16, 19) or 51 <= int(digits[:2]) <= 55 and len(digits) == 16 or digits[:2] in ("34", "37") and len(digits) == 15
        if not brand or not luhn(digits):
            return m
        body = digits[4:-1]
        la = len(body) // 2
        x, y = naive_feistel(int(body[:la]), int(body[la:]), 10**la, 10 ** (len(body) - la), "card", key, back)
        body = digits[:4] + f"{x:0{la}}{y:0{len(body) - la}}"
        new = iter(body + next(c for c in "0123456789" if luhn(body + c)))
    return "".join(next(new) if c.isdigit() else c for c in m)


def test_pii_against_the_definition(spark):
    """Values of every shape: the same pseudonym as by hand, of the same shape, and back again."""
    rng = np.random.default_rng(11)
    n = lambda low, high: int(rng.integers(low, high))
    values = ["1/2/2020", "13/02/2020", "31/1/1999", "2020-12.31", "29.02.2000", "29/2/2004", "2/29/1904", "1.1.1799", "31.04.2001", "010.001.2.3", "1.2.3.4", "255.9.99.100", "+1 000-000-0000", "(211) 234-5678", "+44 123 456 7890", "+44 023 456 7890", "666-12-1234", "000-12-1234"]
    for _ in range(60):
        y, m, d = n(1800, 2200), n(1, 13), n(1, 29)
        values += [f"{y}-{m:02}-{d:02}", f"{y}.{m:02}.{d:02}", f"{d}.{m}.{y}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{m:02}/{d}/{y}", f"{d}/{m}/{y}"]
        values += [".".join(str(n(0, 256 if rng.random() < 0.7 else 20)) for _ in range(4)), f"{n(1, 999):03}-{n(0, 100):02}-{n(0, 10000):04}"]
        values += [f"+1 ({n(200, 1000)}) {n(200, 1000)}-{n(0, 10000):04}", f"{n(100, 1000)}-{n(100, 1000)}-{n(0, 10000):04}", f"+{n(1, 400)} {n(0, 1000):03} {n(0, 1000):03} {n(0, 10000):04}"]
        for head, size in (("4", 16), ("4", 13), (str(n(51, 56)), 16), ("37", 15), ("9", 16)):
            body = head + "".join(str(n(0, 10)) for _ in range(size - 1 - len(head)))
            whole = body + next(c for c in "0123456789" if luhn(body + c))
            values += [whole, "-".join(whole[k : k + 4] for k in range(0, 16, 4)) if size == 16 else whole]
    df = spark.createDataFrame([(k, f"a {v} z") for k, v in enumerate(values)], "doc_id long, text string")
    out = pii.pseudonymise(df, "k")
    got = {r.doc_id: r.text[2:-2] for r in out.collect()}
    for k, v in enumerate(values):
        whole = not re.search(r"^\d{4}-\d\d\.", v)
        want = naive_value(v, "k") if whole else v
        assert got[k] == want and re.sub(r"\d", "9", got[k]) == re.sub(r"\d", "9", v), v
        assert naive_value(got[k], "k", back=True) == v if whole else True
    assert sum(got[k] != v for k, v in enumerate(values)) > 0.7 * len(values)
    back = {r.doc_id: r.text[2:-2] for r in pii.pseudonymise(out, "k", back=True).collect()}
    assert back == dict(enumerate(values))


def test_pii_key_comes_from_the_settings(spark, monkeypatch):
    spark.conf.unset(pii.KEY_SETTING)
    monkeypatch.setenv(pii.KEY_VARIABLE, "mine")
    assert pii.key_of(spark) == "mine"
    monkeypatch.delenv(pii.KEY_VARIABLE)
    key = pii.key_of(spark)
    assert len(key) == 32 and pii.key_of(spark) == key
    spark.conf.unset(pii.KEY_SETTING)
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(spark.range(1).select(F.lit("x").alias("text")), "")


def test_pii_beside_columns_of_any_name(spark):
    df = spark.createDataFrame([("call +1 (417) 555-7713", 22, "a", "b", "c")], "text string, n_chars int, pii string, `_pii` string, `a.b` string")
    row = pii.pseudonymise(df, "k", length="n_chars").first()
    assert row[2:] == ("a", "b", "c") and row.n_chars == 22 and row.text != "call +1 (417) 555-7713"


def test_feistel_is_a_bijection(spark):
    df = spark.range(189 * 773).select(F.floor(F.col("id") / 773).alias("a"), (F.col("id") % 773).alias("b"))
    out = df.select(pii.feistel(F.col("a"), F.col("b"), F.lit(189), F.lit(773), "date", F.lit("k")).alias("s"))
    assert out.where("s.x between 0 and 188 and s.y between 0 and 772").distinct().count() == 189 * 773


def test_pii_on_odd_rows(odd, none):
    out = pii.pseudonymise(odd, "k", length="n_chars")
    assert out.columns == odd.columns and out.count() == odd.count() and pii.pseudonymise(none, "k").count() == 0


# quality

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = llm.op2_quality_pu(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.predicted for r in got if r.quality == 1]
    assert sum(good) >= 0.95 * len(good)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (2, 1), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert quality.score(none, labels).count() == 0
    assert {r.score for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_class_prior():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    cuts, u = quality.cuts_of(p[:2000]), np.r_[p[2000:], n[:1000]]
    bins = np.array([sum((cuts <= z).sum() == k for z in u) for k in range(len(cuts) + 1)])
    assert abs(quality.class_prior(p[:2000], cuts, bins) - 2 / 3) < 0.07


def test_risk_and_gradient_against_the_definition():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (7, 4)), rng.normal(0, 1, (9, 4))
    for prior, turned in ((0.3, False), (3.0, True)):
        layers = [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), np.array([0.5])]

        def parts(w, prior=prior):
            f = lambda x: sum(np.tanh(sum(x[i] * w[0][i, j] for i in range(4)) + w[1][j]) * w[2][j] for j in range(3)) + w[3][0]
            good = prior * np.mean([np.log1p(np.exp(-f(x))) for x in p])
            return good, np.mean([np.log1p(np.exp(f(x))) for x in u]) - prior * np.mean([np.log1p(np.exp(f(x))) for x in p])

        good, bad = parts(layers)
        assert (bad < 0) == turned
        value, grads = quality.risk(layers, p, u, prior)
        assert abs(value - good - max(0, bad)) < 1e-9
        for k, w in enumerate(layers):
            for at in np.ndindex(w.shape):
                change = []
                for step in (1e-5, -1e-5):
                    w[at] += step
                    a, b = parts(layers)
                    change.append(-b if turned else a + b)
                    w[at] -= step
                assert abs(grads[k][at] - (change[0] - change[1]) / 2e-5) < 1e-6


def test_quality_means_cover_every_text(spark, docs):
    """Whatever the sample, means and deviations are those of all texts of the learning folds."""
    seen = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    x = quality.features(pa.array(seen)).astype(float)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for sample in (20, 12_000):
        model = quality.learn(docs, labels, sample=sample)
        assert np.allclose(model.mean, x.mean(0), atol=1e-4) and np.allclose(model.scale, x.std(0) + 1e-3, atol=2e-3)


# substrings

def brute_windows(texts, w=35):
    seen = Counter(tuple(t[i : i + w]) for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - w + 1):
            if seen[tuple(t[i : i + w])] > 1:
                gone.update(range(i, i + w))
        out.append([x for i, x in enumerate(t) if i not in gone])
    return out


@pytest.mark.parametrize(("many", "index"), [(4096, 1 << 19), (2, 600)])
def test_substrings_against_brute_force(spark, monkeypatch, many, index):
    monkeypatch.setattr(substrings, "MANY", many)
    monkeypatch.setattr(substrings, "INDEX", index)
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 120)) for _ in range(6)]
    shared = " ".join(f"s{x}" for x in rng.integers(0, 500, 60))
    texts = base + [f"{b} {shared} {c}" for b, c in zip(base, base[1:], strict=False)] + [f"x{k} {shared} y{k}" for k in range(12)] + ["a " * 200, "a b c " * 40, "p q r s t u v w " * 12, base[0], None, "", "ü " + base[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = dict(enumerate(brute_windows([words(t) for t in texts])))
    got = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    assert {k: r.text for k, r in got.items()} == {k: " ".join(v) for k, v in want.items()}
    assert all(r.n_words - r.n_removed == len(want[k]) for k, r in got.items())


def test_substrings_on_odd_rows(odd, none):
    got = substrings.without_repeats(odd).collect()
    assert len(got) == odd.count() and substrings.without_repeats(none).count() == 0
    assert [r.n_removed for r in got if r.doc_id == 4] == [30_000, 30_000]


def test_fm_index():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 5, n) for n in (1, 7, 40, 90)]
    index = fmindex.FMIndex(texts)
    flat = np.concatenate(texts)
    every = [tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)]
    count = Counter(every)
    first = np.cumsum([0, *map(len, texts)])
    ends = np.concatenate([np.arange(a + 12, b + 1) for a, b in zip(first[:-1], first[1:], strict=True) if b - a >= 12])
    want = [max([k for k in range(1, 13) if count[tuple(flat[e - k : e])] >= 2], default=0) for e in ends]
    assert index.statistics(flat, ends, 12).tolist() == want


def test_windows_through_the_index(monkeypatch):
    """Maximal matches against counting, with runs that stand in several places, in one index and in several."""
    rng = np.random.default_rng(12)
    for turn in range(60):
        texts = [rng.integers(0, 3, rng.integers(1, 30)).astype(np.uint64) for _ in range(12)]
        texts += [t[rng.integers(0, len(t)) :] for t in texts[:6]]
        texts = [np.frombuffer(x, np.uint64) for x in dict.fromkeys(t.tobytes() for t in texts) if x]
        copies = rng.integers(1, 3, len(texts)).tolist()
        count = Counter()
        for t, c in zip(texts, copies, strict=True):
            count.update({tuple(t[i : i + 6]): 0 for i in range(len(t) - 5)})
            for i in range(len(t) - 5):
                count[tuple(t[i : i + 6])] += c
        want = [[i for i in range(len(t) - 5) if count[tuple(t[i : i + 6])] > 1] for t in texts]
        monkeypatch.setattr(substrings, "INDEX", 1 << 19 if turn % 2 else 40)
        assert [x.tolist() for x in substrings.repeated_windows(texts, copies, 6)] == want


# n-gram Jaccard join

def shingles(t, n=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(sets, num, den):
    own = {k: k for k in sets}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            own[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def families(rng):
    """Texts of many sizes, each with near copies around the threshold, and a passage that many texts share."""
    texts = []
    for size in (1, 3, 5, 8, 14, 30, 60, 150, 400):
        base = [f"w{x}" for x in rng.integers(0, 3000, size)]
        texts.append(" ".join(base))
        for edits in (1, 1, 2, max(1, size // 60), max(1, size // 45), max(1, size // 40), max(1, size // 30)):
            new = list(base)
            for at in rng.integers(0, size, edits):
                new[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(new))
            texts.append(" ".join(new[: max(1, size - edits)]))
    passage = " ".join(f"p{x}" for x in range(80))
    texts += [f"{passage} {' '.join(f'q{x}' for x in rng.integers(0, 10**6, k))}" for k in range(1, 60)]
    return texts + [None, "", "  ", "One Two", "one  two", "the same words as here again", "the same words as here again"]


@pytest.mark.parametrize(("num", "shingle", "most"), [(85, 4, 4096), (85, 4, 3), (80, 5, 6)])
def test_jaccard_against_brute_force(spark, monkeypatch, num, shingle, most):
    monkeypatch.setattr(jaccard, "MOST", most)
    monkeypatch.setattr(jaccard, "DEALT", 5000)
    reached = []
    real = jaccard._survivors

    def survivors(*args):
        out = real(*args)
        reached.extend(r.rep for r in out.select("rep").distinct().collect())
        return out

    monkeypatch.setattr(jaccard, "_survivors", survivors)
    texts = families(np.random.default_rng(3))
    sets = {k: shingles(t, shingle) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in jaccard.near_duplicates(df, shingle, num, 100).collect()}
    want = brute_components(sets, num, 100)
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    # whatever is linked with another set came out of a tree
    first = {}
    for k, s in sets.items():
        first.setdefault(frozenset(s), k)
    groups = defaultdict(set)
    for k, s in sets.items():
        groups[want[k]].add(first[frozenset(s)])
    assert {x for g in groups.values() if len(g) > 1 for x in g} <= set(reached)


def test_jaccard_candidates_do_not_stand_for_links(spark, monkeypatch):
    """Groups of two linked pairs that meet in different chunks: of the pairs across, all of which survive the trees, one is a link."""
    monkeypatch.setattr(jaccard, "MOST", 3)
    rows = {}
    for q in (4, 12, 20, 24):  # by the hashes of these ids the linked pairs lie in different chunks
        word = [f"q{q}w{k}" for k in range(120)]
        rows |= {4 * q + k: " ".join(word[at : at + 103]) for k, at in enumerate((0, 1, 9, 10))}
    got = jaccard.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_components({k: shingles(t, 4) for k, t in rows.items()}, 85, 100) == {k: k // 4 * 4 for k in rows}


def test_jaccard_keys_with_repeated_ids_are_told_apart(spark):
    """An id that two sets of a key have must not cancel out: keys of {1, 2, 2, 9} and of {1, 3, 3, 9} aren't the same."""
    shared = spark.createDataFrame([(k, rep, 50) for k, reps in ((7, (1, 2, 2, 9)), (8, (1, 3, 3, 9))) for rep in reps], "key long, rep long, n_shingles long")
    labels = spark.createDataFrame([], "node long, component long")
    assert {r.task for r in jaccard._open(shared, labels).collect()} == {7, 8}


def test_jaccard_keys_are_complete():
    """Linked sets share a key that both keep, whatever the order of shingles and however many hold each key."""
    rng = np.random.default_rng(4)
    rank = rng.integers(0, 4, jaccard.CELLS).astype(np.uint8)
    for num in (80, 85):
        for n in [*range(6, 40), 100, 333, 900]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for _ in range(20):
                gone = int(rng.integers(1, max(2, n // 9)))
                b = np.unique(np.r_[np.delete(a, rng.integers(0, len(a), gone)), rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1)), dtype=np.uint64)])
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                    keys, doc = jaccard.prefix(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), rank, num, 100)
                    often = dict(zip(np.unique(keys).tolist(), rng.permutation(len(np.unique(keys))).tolist(), strict=True))
                    kept = []
                    for d, s in enumerate((a, b)):
                        mine = sorted(keys[doc == d].tolist(), key=often.get, reverse=True)
                        kept.append(set(mine[-(len(s) * num // -100) // jaccard.SPARE :]))
                    assert kept[0] & kept[1]


def test_points_that_overflow_bound_nothing():
    same = np.arange(40, dtype=np.uint64)  # all in one group
    p = jaccard.point(same)
    assert jaccard.folded(p, 40, 16).max() == 40 and jaccard.folded(p, 40, 16).sum() >= 40
    assert jaccard.connect([p, p], np.array([40, 40]), np.arange(2), np.zeros(2, int), 85, 100)[0] == [(0, 1)]


def test_r_tree_join_is_complete():
    rng = np.random.default_rng(5)
    points = rng.poisson(4, (200, 16))
    points[100:] = np.maximum(points[:100] + rng.integers(-1, 2, (100, 16)) * (rng.random((100, 16)) < 0.1), 0)
    sizes = points.sum(1)
    tree = rtree.CountTree(points, sizes)
    found = {tuple(sorted(p)) for a, b in tree.join(tree, 85, 100, lambda *_: False) for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i, j in combinations(range(200), 2):
        most = int(np.minimum(points[i], points[j]).sum())
        if 100 * most >= 85 * int(sizes[i] + sizes[j] - most):
            assert (i, j) in found


def test_jaccard_on_odd_rows(odd, none):
    got = jaccard.near_duplicates(odd).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == [(0, 1)] and by[7] == [(1, 6)] and by[6] == [(1, 6)] and by[None][0][1] is None and len(by[4]) == 2
    kept = jaccard.first_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 8, 9]
    assert jaccard.near_duplicates(none).count() == 0


def test_orders():
    rng = np.random.default_rng(13)
    for high in (1 << 63, 50, 1 << 21):  # ties in all that is compared first, and in all
        doc, value = np.sort(rng.integers(0, 9, 400)), rng.integers(0, high, 400).astype(np.uint64)
        order = words_module.within(doc, value)
        assert (np.c_[doc, value][order] == np.c_[doc, value][np.lexsort((value, doc))]).all()
        major, minor = rng.integers(0, high, 400), rng.integers(0, 5, 400)
        order = words_module.by_pairs(major, minor)
        assert (np.c_[major, minor][order] == np.c_[major, minor][np.lexsort((minor, major))]).all()
    assert len(words_module.within(doc[:0], value[:0])) == len(words_module.by_pairs(major[:0], minor[:0])) == 0
    assert words_module.within(np.array([1 << 20, 0]), value[:2]).tolist() == [1, 0]


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sets = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            sets[a].add(b)
            sets[b].add(a)
    seen = {}
    for start in sorted(sets):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = start
                todo += sets[x]
    assert got == seen


# decontamination

def test_leaks(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: words(r.text) for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    texts = {r.doc_id: " ".join(words(r.text)) for r in docs.collect()}
    whole = {(d, i) for d, t in texts.items() for i, w in items.items() if " ".join(w) in t}
    assert whole <= got
    for d, i in got - whole:  # anything else shares most of the item's word runs
        grams = {tuple(items[i][k : k + 3]) for k in range(len(items[i]) - 2)}
        have = words(texts[d])
        assert len(grams & {tuple(have[k : k + 3]) for k in range(len(have) - 2)}) > 0.5 * len(grams)


def test_block_max_bounds_lose_nothing():
    rng = np.random.default_rng(7)
    items = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(4, 120)) % 800) for _ in range(90)]
    index = decontaminate.Index(list(range(90)), items)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, 300) % 800) for _ in range(20)] + [f"a b {items[k]} c" for k in range(20)]
    w = decontaminate.Words(pa.array(texts), plain=True)
    got = {(r, i, a): s for r, i, a, _, s in index.retrieve(w, 0.45)}
    term = index.term_of(w.hash)
    for row in range(40):
        n = int(w.count[row])
        for turn in range(max(1, -(-(n - decontaminate.PIECE) // decontaminate.PIECE))):
            a = int(w.first[row]) + turn * decontaminate.PIECE
            mine = set(term[a : min(a + 2 * decontaminate.PIECE, int(w.first[row + 1]))].tolist())
            score = np.bincount(index.post_piece, index.impact * np.isin(index.post_term, list(mine)), minlength=len(index.owner))
            for piece in np.flatnonzero(score >= 0.4501):
                assert (row, int(index.owner[piece]), a) in got


def test_scores_are_the_same_in_parts(spark, monkeypatch):
    """Partial copies near the threshold come or go alike, however many parts the benchmark is held in."""
    rng = np.random.default_rng(9)
    items = [" ".join(f"t{int(x)}" for x in rng.zipf(1.4, rng.integers(6, 90)) % 400) + "." for _ in range(120)]
    texts = []
    for k, item in enumerate(items):
        w = item.split()
        cut = rng.random(len(w)) < rng.choice([0.05, 0.2, 0.4])
        texts.append(f"a b c {' '.join(f'z{k}' if c else x for x, c in zip(w, cut, strict=True))} d e")
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench, question=0.2, answer=0.2).collect()}
    monkeypatch.setattr(decontaminate, "ITEMS", 12)
    assert len(decontaminate.indexes(bench)) == 10
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench, question=0.2, answer=0.2).collect()}
    assert set(got) == set(want) and 20 < len(got) < 120
    assert all(abs(got[k].score - want[k].score) < 1e-9 for k in want)


def test_index_grows_with_its_postings():
    rng = np.random.default_rng(10)
    index = decontaminate.Index(list(range(600)), [" ".join(f"u{int(x)}" for x in rng.integers(0, 10**6, 64)) for _ in range(600)])
    assert len(index.max_key) <= len(index.impact) <= 600 * 64 and index.blocks == 75


def test_leaks_on_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (4, "w1 w2 w3 w4 w5 w6 w7 w8. w9 w10 w11"), (5, "!!!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, bench).collect()}
    assert got == {(None, 1), (4, 4)}
    kept = decontaminate.without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0


# language

def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = llm.op7_language_mixture(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98


def naive_words(text):
    """Words as lists of buckets, by character: letters and marks stay, A-Z in lower case."""
    out = []
    for w in "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text or "").split():
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in w.encode())
        b = b"\0" + b + b"\0"
        codes = []
        for size in (2, 3, 4):
            for i in range(size - 1, len(b)):
                # an n-gram ends at a letter, or at the edge behind the word; it may begin at the edge before it
                code = int.from_bytes(b[i - size + 1 : i + 1], "big")
                codes.append(int(mix(np.array([code + (size - 1 << 40)], np.uint64))[0]) >> 48)
        out.append(codes)
    return out


def naive_mixture(text, table, penalty=1.0):
    """(language, share) by the definition, word by word."""
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return -1, 0.0
    log = np.array([[row[c].sum(dtype=float) for row in table] for c in naive_words(text)])
    like = np.exp(0.3 * (log - log.max(1, keepdims=True)))

    def em(part, steps):
        share = np.full(part.shape[1], 1 / part.shape[1])
        for _ in range(steps):
            total = (part * share).sum(1)
            share = (part * share / total[:, None]).sum(0)
            share = share / share.sum()
        return share, np.log(total).sum()

    order = np.argsort(-em(like, 10)[0], kind="stable")
    best, worth = None, -np.inf
    for k in range(1, len(table) + 1):
        share, total = em(like[:, order[:k]], 1 if k == 1 else 10)
        total -= penalty * (k - 1) * np.log(len(like) + 1)
        if total <= worth + 1e-9:
            break
        best, worth = dict(zip(order[:k].tolist(), share.tolist(), strict=True)), total
    lang = max(sorted(best), key=best.get)
    return lang, best[lang]


def test_language_against_the_definition(spark, docs):
    langs, table = langid.learn(docs)
    seen = [r for r in docs.where("lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert langs == sorted({r.lang for r in seen})
    for k, lang in enumerate(langs):
        counts = Counter(c for r in seen if r.lang == lang for w in naive_words(r.text) for c in w)
        want = np.full(langid.BUCKETS, 0.5)
        want[list(counts)] += list(counts.values())
        assert np.allclose(table[k], np.log(want / want.sum()), atol=1e-4)
    texts = [r.text for r in docs.limit(60).collect() if len(r.text or "") < 4000]
    texts += [f"{a} {b}" for a, b in zip(texts, texts[7:], strict=False)] + ["ÀÉ naïve cafe\u0301 中文 हिन्दी", "x", "", None, "———", "… 123 “”", "✓✓", "€ 5", "\u00a0", "\u0301"]
    best, score, _ = langid.mixture(pa.array(texts), table)
    for text, b, s in zip(texts, best.tolist(), score.tolist(), strict=True):
        want = naive_mixture(text, table)
        assert (b, pytest.approx(s, abs=2e-3)) == want, text


def test_long_texts_are_read_in_parts(docs):
    langs, table = langid.learn(docs)
    text = " ".join(r.text or "" for r in docs.collect()) + " ———"
    parts = list(langid._parts(pa.array([text]), 50_000))
    assert "".join(p[0].as_py() for p in parts) == text and len(parts) > 2
    whole = langid.mixture(pa.array([text]), table)
    real = langid._parts
    langid._parts = lambda x: real(x, 50_000)
    try:
        cut = langid.mixture(pa.array([text]), table)
    finally:
        langid._parts = real
    assert whole[0] == cut[0] and abs(whole[1] - cut[1]) < 1e-3 and whole[2] == cut[2]
    assert [p[0].as_py() for p in real(pa.array(["é" * 10]), 5)] == ["ééé", "ééé", "ééé", "é"]


def test_language_mixture_counts_languages(spark, docs):
    langs, table = langid.learn(docs)
    en, fr = (" ".join(r.text for r in docs.where(f"lang = '{x}' and length(text) between 500 and 5000").limit(3).collect())[:3000] for x in ("en", "fr"))
    best, score, size = langid.mixture(pa.array([en, fr, en + " " + fr, None, "", "12 !"]), table)
    assert [langs[b] if b >= 0 else "und" for b in best] [:2] == ["en", "fr"] and best[3:].tolist() == [-1, -1, -1]
    assert size[0] == 1 and size[2] >= 2 and 0.3 < score[2] < 0.75 and score[0] > 0.95


def test_language_on_odd_rows(odd, none):
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd).collect()}
    assert got[1] == got[2] == got[9] == "und" and got[8] in ("en", "fr")
    assert langid.predict(none).count() == 0


# mixing

def test_mixing_against_brute_force(docs):
    got = mixing.mixture(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: s.encode())
    left, total, goal = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: total * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        for s in over or list(left):
            goal[s] = min(share[s], 2 * sizes[s])
            del left[s]
        total -= sum(goal[s] for s in over)
        if not over:
            break
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    assert {(r.doc_id, r.taken) for r in mixing.mixture(docs.repartition(5)).collect()} == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(docs).groupBy().agg(F.sum(common.n_words(F.col("text")))).first()[0] == sum(taken.values())


def test_smaller_budgets_are_nested(docs):
    less = {(r.doc_id): r.copies for r in mixing.mixture(docs, share=0.5).collect()}
    more = {(r.doc_id): r.copies for r in mixing.mixture(docs, share=0.8).collect()}
    assert all(more[k] >= v for k, v in less.items())


def test_mixing_on_odd_rows(odd, none):
    got = mixing.mixture(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r.size for r in got) and sum(r.size for r in got if r.doc_id in (1, 2, 3)) == 0
    assert mixing.mixture(none).count() == 0 and mixing.mix(odd).columns == [*odd.columns, "mix_copy"]


def test_hash_is_sha256_of_kept_words(spark):
    r = llm.op4_substring_dedup(spark, SF).where("n_words > 0 and n_removed = 0").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id = {r.doc_id}").first().text
    assert r.kept_sha256 == sha256(" ".join(words(text)).encode()).hexdigest()
