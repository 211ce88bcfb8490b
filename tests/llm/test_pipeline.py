"""The corpus pipeline against a version that does every stage by definition, and on odd and empty tables."""

import re
from collections import Counter
from math import log1p

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import decontaminate, mixing, pii, quality
from tests.llm.test_documents import brute_components, shingles, words

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def naive_leaks(docs, items, threshold=0.6, question=0.6, answer=0.5):
    """doc_ids of the texts that hold an item: BM25 of every passage and piece, then both overlaps."""
    pieces, gone = [], set()
    for text in items:
        w = plain_words(text)
        for part in np.array_split(np.array(w, object), -(-len(w) // 32)) if w else []:
            pieces.append((text, part.tolist()))
    df = Counter(t for _, p in pieces for t in set(p))
    mean = np.mean([len(p) for _, p in pieces])
    weigh = lambda t, n, size: log1p((len(pieces) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean))
    impacts = []
    for text, p in pieces:
        own = {t: weigh(t, n, len(p)) for t, n in Counter(p).items()}
        impacts.append((text, {t: v / sum(own.values()) for t, v in own.items()}))
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    for doc_id, text in docs:
        w = plain_words(text)
        for start in range(0, max(1, len(w) - 32), 32):
            here = set(w[start : start + 64])
            for item, own in impacts:
                if sum(v for t, v in own.items() if t in here) < threshold - 1e-9:
                    continue
                q = plain_words(item)
                cut = decontaminate._answer_at(item, len(q))
                near = w[max(0, start - len(q)) : min(len(w), start + 64) + len(q)]
                parts = [runs(x, min(3, len(x))) for x in (q[:cut], q[cut:])]
                have = set().union(*(runs(near, n) for n in (1, 2, 3)))
                if all(not p or len(p & have) / len(p) >= least for p, least in zip(parts, (question, answer), strict=True)):
                    gone.add(doc_id)
    return gone


def test_pipeline_against_the_definition(spark):
    spark.conf.set(pii.KEY_SETTING, "k")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.score(quality.features(pa.array([r.text for r in rows.values()])).astype(float))
    kept = [k for k, s in zip(rows, score, strict=True) if s >= 0.7]
    own = brute_components({k: shingles(rows[k].text, 5) for k in kept}, 80, 100)
    kept = [k for k in kept if own[k] == k]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = naive_leaks([(k, rows[k].text) for k in kept], items)
    kept = [k for k in kept if k not in leaked]
    # row by row
    clean = pii.pseudonymise(docs.where(F.col("doc_id").isin(kept)), "k", length="n_chars").withColumn("h", mixing.row_hash(0)).collect()
    size = {r.doc_id: len(words(r.text)) for r in clean}
    total = Counter()
    for r in clean:
        total[r.source] += size[r.doc_id]
    goal, left, budget = {}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: s.encode()))}, 1.5 * sum(total.values())
    while left:
        share = {s: budget * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 2 * total[s]]
        for s in over or list(left):
            goal[s] = min(share[s], 2 * total[s])
            del left[s]
        budget -= sum(goal[s] for s in over)
    want = Counter()
    for s in goal:
        mine = sorted((r for r in clean if r.source == s), key=lambda r: r.h)
        whole = int(goal[s] // total[s])
        rest = goal[s] - whole * total[s]
        for r in mine:  # up to the row that comes nearest
            take = rest > 0 and 2 * rest >= size[r.doc_id]
            rest -= size[r.doc_id]
            want[tuple(r)[:-1]] += whole + take
    got = Counter(tuple(r)[:-1] for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and len(got) > 20


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, tmp_path, empty):
    long = " ".join(f"w{k % 900}" for k in range(20_000))
    texts = [None, "", " \n\t", long, long, "one two three four five six", "mail a@b.example and +1 (417) 555-7713 please", "é" * 50, "ONE two  THREE four FIVE six"]
    rows = [(k if k != 5 else None, t, None if k % 3 else "en", None if k == 2 else f"s{k % 2}", len(t or ""), 0.5, "x", "y", 7, "z") for k, t in enumerate(texts)]
    rows.append(rows[3])
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _pii string, pii string, mix_copy long, kept string"
    sf = str(tmp_path)
    spark.createDataFrame(rows[:0] if empty else rows, schema).write.parquet(f"{sf}/documents.parquet")
    labels = [(k, 1, 0) for k in range(9)] + [(3, None, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "no such words stand anywhere here. none")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "mixing" or out.columns == docs.columns)
        assert not empty or out.count() == 0
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "mix_copy_"]
    if not empty:
        for name in ("near_duplicates", "decontamination", "pii"):
            out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf).collect()
            ids = sorted(-1 if r.doc_id is None else r.doc_id for r in out)
            assert ids == ([-1, 0, 1, 2, 3, 6, 7, 8] if name == "near_duplicates" else sorted([*(k for k in range(9) if k != 5), 3, -1]))
            assert all(r.kept == "z" and r.mix_copy == 7 and r._pii == "x" for r in out)


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(columns)] == columns
        if name != "mixing":
            assert out.columns == columns and 0 < out.count() <= docs.count()
            docs = out.cache()
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, SF).count() == corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
