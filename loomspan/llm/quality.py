"""Document quality by positive-unlabelled learning.

Features come from a text's bytes and words alone: shares of character classes and of pairs of classes that follow one
another, word lengths, and how often words, word pairs and lines repeat. A small network is fitted so as to minimise
the non-negative unbiased risk (Kiryo et al., 2017): labelled good texts are the trusted positives, and the corpus as it is, its
documents of the learning folds whether labelled or not, is the unlabelled web. The share of good texts in it is estimated
first, as the least ratio of unlabelled to positive mass above a score (Garg et al., 2021), from positives that the network
hasn't seen and a histogram of the scores of every unlabelled text. Means and deviations of the features are those of every
unlabelled text too; they are sums of integers, so that no order of tasks changes them. A logistic curve fitted on the
labelled rows that the network hasn't seen turns its output into a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import fold, materialize, quoted, scratch
from loomspan.llm.words import Words, pieces, raw, within

#: Labelled rows, and texts of the corpus, that the network's steps go over, at most about twice and once this number; which
#: ones they are depends on doc_id alone.
SAMPLE = 12_000
#: Unit of the features' sums; rows that a model scores at a time.
_UNIT, _ROWS = 1 << 16, 2048
_HIDDEN, _EPOCHS, _BATCH, _RATE, _DECAY, _SEED = 32, 25, 512, 3e-3, 1e-4, 11

_CLASSES = 13
_CLASS = np.full(256, 9, np.uint8)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\x0b\x0c", b".,;:", b"!?", b"'\"()-", b"#$%&*", (), b"|", range(0xC0, 0x100), range(0x80, 0xC0))):
    _CLASS[list(_set)] = _k


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each document has."""
    order = within(doc, values)
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text, of the same width; zeros for null and empty ones but for the bias."""
    words = Words(texts)
    n, data, offsets = len(words.count), words.data, words.offsets
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kind = _CLASS[data].astype(np.int64)
    shares = np.bincount(doc * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES)
    inside = doc[1:] == doc[:-1]
    pairs = np.bincount(((doc[1:] * _CLASSES + kind[1:]) * _CLASSES + kind[:-1])[inside], minlength=n * _CLASSES**2).reshape(n, -1)
    same = np.bincount(doc[1:][inside & (data[1:] == data[:-1])], minlength=n)
    many = words.count
    length = words.end - words.start
    of = words.doc()
    mean = _ratio(np.bincount(of, length, minlength=n), many)
    spread = np.sqrt(np.maximum(_ratio(np.bincount(of, length.astype(float) ** 2, minlength=n), many) - mean**2, 0))
    short = _ratio(np.bincount(of[length <= 2], minlength=n), many)
    long = _ratio(np.bincount(of[length > 14], minlength=n), many)
    grams, _, first = words.grams(2)
    gram_doc = np.repeat(np.arange(n), np.diff(first))
    ends = _CLASS[data[words.end - 1]] if len(of) else np.empty(0, np.uint8)
    starts = _CLASS[data[words.start]] if len(of) else np.empty(0, np.uint8)
    tails = np.bincount(of * _CLASSES + ends, minlength=n * _CLASSES).reshape(n, _CLASSES)
    heads = np.bincount(of * _CLASSES + starts, minlength=n * _CLASSES).reshape(n, _CLASSES)
    extra = [
        _ratio(same, size), mean, spread, short, long, np.log1p(many), np.log1p(size),
        _ratio(_distinct(words.hash, of, n), many), _ratio(_distinct(grams, gram_doc, n), np.maximum(many - 1, 1)),
        _ratio(shares[:, 4], many),
    ]
    dense = [np.sqrt(_ratio(x, size[:, None])) for x in (shares, pairs)] + [np.sqrt(_ratio(x, many[:, None])) for x in (tails, heads)]
    return np.column_stack([*dense, *extra, np.ones(n)]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float = 0.5
    curve: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Some rows at a time: x may be all that was drawn."""
        a, b, c, d = self.layers
        parts = [np.tanh((x[k : k + _ROWS] - self.mean) / self.scale @ a + b) @ c + d for k in range(0, len(x), _ROWS)]
        return np.concatenate(parts) if parts else np.empty(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.curve[0] * self.raw(x) + self.curve[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss, and the direction to step against: its gradient,
    or, where the negative risk has fallen below zero, that of the negative risk turned round."""
    x = np.concatenate([p, u])
    hidden = np.tanh(x @ layers[0] + layers[1])
    z = hidden @ layers[2] + layers[3]
    zp, zu = z[: len(p)], z[len(p) :]
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative >= 0:
        g = np.concatenate([-prior * np.ones(len(p)) / len(p), _sigmoid(zu) / len(u)])
    else:
        g = np.concatenate([prior * _sigmoid(zp) / len(p), -_sigmoid(zu) / len(u)])
    back = np.outer(g, layers[2]) * (1 - hidden**2)
    return float(positive + max(0.0, negative)), [x.T @ back, back.sum(0), hidden.T @ g, np.array([g.sum()])]


def _train(p: np.ndarray, u: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray) -> Model:
    """Minimises the risk by Adam."""
    rng = np.random.default_rng(_SEED)
    wide = p.shape[1]
    layers = [rng.normal(0, 1 / np.sqrt(wide), (wide, _HIDDEN)), np.zeros(_HIDDEN), rng.normal(0, 1 / np.sqrt(_HIDDEN), _HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(_EPOCHS):
        turns = max(1, -(-max(len(p), len(u)) // _BATCH))
        rows_p, rows_u = (np.resize(rng.permutation(len(x)), turns * _BATCH) for x in (p, u))
        for k in range(turns):
            cut = slice(k * _BATCH, (k + 1) * _BATCH)
            _, grads = risk(layers, (p[rows_p[cut]] - mean) / scale, (u[rows_u[cut]] - mean) / scale, prior)
            step += 1
            for i, grad in enumerate(grads):
                grad = grad + (_DECAY * layers[i] if i in (0, 2) else 0)
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                layers[i] -= _RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, layers, prior)


def cuts_of(positive: np.ndarray) -> np.ndarray:
    """Scores above which masses are compared."""
    return np.unique(np.quantile(positive, np.linspace(0, 0.99, 200)))


def class_prior(positive: np.ndarray, cuts: np.ndarray, bins: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio, over the cuts, of the masses at or above, each with its
    confidence bound. bins: how many unlabelled scores have 0, 1, ... cuts at or below them."""
    total = max(1, int(bins.sum()))
    up = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    uu = bins[::-1].cumsum()[::-1][1:] / total
    slack = np.sqrt(np.log(40) / 2 / len(positive)) + np.sqrt(np.log(40) / 2 / total)
    ok = up > 2 * slack
    if not ok.any():
        return 0.5
    best = np.argmin(np.where(ok, (uu + slack) / np.maximum(up, 1e-9), np.inf))
    return float(np.clip(uu[best] / up[best], 0.05, 0.99))


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic curve by Newton steps, with the customary smoothed targets."""
    good, bad = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.array([1.0, 0.0])
    x = np.column_stack([z, np.ones_like(z)])
    for _ in range(50):
        q = _sigmoid(x @ w)
        h = x.T @ (x * (weight * q * (1 - q))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (q - t)))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(x: np.ndarray, y: np.ndarray, u: np.ndarray, mean: np.ndarray, scale: np.ndarray, bins: Callable[[Model, np.ndarray], np.ndarray]) -> Model:
    """x, y: labelled rows; u: rows of the corpus for the network's steps; mean, scale: of the whole corpus; bins: the histogram
    of its scores between cuts. One positive in five is kept from the network, for the prior and the curve. Without positives
    or without a corpus all scores are one half."""
    wide = len(mean)
    if not (y == 1).any() or not len(u):
        return Model(np.zeros(wide), np.ones(wide), [np.zeros((wide, 1)), np.zeros(1), np.zeros(1), np.zeros(1)])
    good = x[y == 1]
    aside = np.arange(len(good)) % 5 == 4
    p, rest = good[~aside], good[aside] if aside.any() else good
    first = _train(p, u, 0.5, mean, scale)
    seen = first.raw(rest)
    cuts = cuts_of(seen)
    model = _train(p, u, class_prior(seen, cuts, bins(first, cuts)), mean, scale)
    if (y == 0).any():
        bad = x[y == 0]
        weight = np.r_[np.full(len(rest), len(good) / len(rest)), np.ones(len(bad))]
        model.curve = _platt(model.raw(np.concatenate([rest, bad])), np.r_[np.ones(len(rest)), np.zeros(len(bad))], weight)
    return model


def _below(share: float) -> Column:
    """Rows whose doc_id falls below a share of the hash space."""
    return F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1


@scratch()
def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """Fits the model on the rows outside the held-out fold. A doc_id with several labels has the smallest one."""
    seen = docs.where("doc_id is not null").where(fold(F.col("doc_id"), folds) != held).select("doc_id", "text")
    marks = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id"), folds) != held)
    marks = marks.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share_l = min(1.0, 2 * sample / max(1, marks.count()))
    share_u = min(1.0, sample / max(1, seen.count()))
    # about 2 * sample rows of two numbers, however many labels there are
    some = F.broadcast(marks.where(_below(share_l)))
    both = seen.join(some, "doc_id", "left").select("text", "quality", _below(share_u).alias("drawn"))
    wide = features(pa.array([""])).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "x", "at", "n", "squares"]
        sums, squares, rows = np.zeros(wide, np.int64), np.zeros(wide, np.int64), 0
        for b in pieces(batches):
            x = features(b.column(0))
            sums += np.rint(x.astype(np.float64) * _UNIT).astype(np.int64).sum(0)
            squares += np.rint(x.astype(np.float64) ** 2 * _UNIT).astype(np.int64).sum(0)
            rows += len(x)
            quality = pc.fill_null(b.column(1), -1).to_numpy()
            for kind, at in ((0, np.flatnonzero(quality == 0)), (1, np.flatnonzero(quality > 0)), (2, np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False)))):
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array([r.tobytes() for r in x[at]], pa.binary()), pa.nulls(len(at), pa.int32()), none, none], names)
        at = pa.array(np.arange(wide + 1, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(wide + 1, 3, np.int32)), pa.nulls(wide + 1, pa.binary()), at, pa.array(np.r_[sums, rows]), pa.array(np.r_[squares, rows])], names)

    table = materialize(both.mapInArrow(run, "kind int, x binary, at int, n long, squares long"), "features")
    drawn = table.where("kind < 3").select("kind", "x").toArrow()
    kind = drawn.column(0).to_numpy()
    x = np.concatenate([np.empty((0, wide), np.float32), *(np.frombuffer(raw(c)[0], np.float32).reshape(-1, wide) for c in drawn.column(1).chunks if len(c))])
    del drawn
    order = np.lexsort((*x.T[:8], x.sum(1), kind)) if len(x) else np.empty(0, np.int64)
    kind, x = kind[order], x[order]
    every = table.where("kind = 3").groupBy("at").agg(F.sum("n"), F.sum("squares")).orderBy("at").toArrow()
    sums, squares = (every.column(k).to_numpy().astype(np.float64) if len(every) else np.zeros(wide + 1) for k in (1, 2))
    rows = max(1.0, sums[-1])
    mean = sums[:-1] / _UNIT / rows
    scale = np.sqrt(np.maximum(squares[:-1] / _UNIT / rows - mean**2, 0)) + 1e-3

    def bins(model: Model, cuts: np.ndarray) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(cuts) + 1, np.int64)
            for b in pieces(batches):
                n += np.bincount(np.searchsorted(cuts, model.raw(features(b.column(0)).astype(np.float64)), "right"), minlength=len(cuts) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["bin", "n"])

        found = seen.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n")).orderBy("bin").toArrow()
        return found.column(1).to_numpy() if len(found) else np.zeros(len(cuts) + 1, np.int64)

    labelled = kind < 2
    return fit(x[labelled], kind[labelled], x[kind == 2], mean, scale, bins)


def _scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            score = model.score(features(b.column(b.schema.get_field_index("text"))).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in columns), pa.array(score)], [*columns, "score"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, f"{schema}, score double")


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, quality. A row for each input row: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other, by their features, which are zeros. Rows that repeat are scored
    alike. Without labels every score is one half.
    """
    out = _scored(docs, learn(docs, labels, folds, held, sample), ["doc_id"])
    held_out = fold(F.col("doc_id"), folds) == held
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that the classifier rejects; columns as they were, whatever their names. Null and empty texts are
    judged by their features, which are zeros; rows that repeat stay or go together; without labels no row reaches 0.7."""
    model = learn(docs, labels, folds, held, sample)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(quoted(c).alias("text" if c == "text" else n) for c, n in zip(docs.columns, names, strict=True)))
    kept = _scored(plain, model, plain.columns).where(F.col("score") >= threshold)
    return kept.select(*(F.col("text" if c == "text" else n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
