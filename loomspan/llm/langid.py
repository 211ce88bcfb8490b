"""Language identification as a mixture: which languages a text holds, and how much of each.

Learning counts hashed letter n-grams (two to four letters, with the word's edges) of all labelled texts, by language.
A text's words are its observations, equal ones together: each has, for every language, a likelihood from its n-grams. Letters
are what Unicode calls so; marks belong to the word that they stand in. Expectation maximisation estimates the shares of the languages; languages enter one after another, by their share, and the set
with the best penalised likelihood stays. The language with the greatest share in that set is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import fold, materialize, scratch
from loomspan.llm.words import CHUNK, mix, pieces, raw, within

#: Hash buckets for n-grams; the model holds this many numbers for each language, and at most so many languages: those with
#: the most n-grams, so that a column of stray values doesn't make the model grow.
BUCKETS, LANGUAGES = 1 << 16, 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS, _TEMPER = 10, 0.3


@cache
def _kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 a mark, 0 anything else."""
    first = [category(chr(k))[0] for k in range(0x110000)]
    return np.array([{"L": 1, "M": 2}.get(x, 0) for x in first], np.uint8)


def _kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 belongs to."""
    kinds = _kinds()
    out = kinds[data & 0x7F]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        long = np.r_[data, np.zeros(3, np.uint8)].astype(np.int32)
        lead = long[at]
        one, two, three = (long[at + k] & 0x3F for k in (1, 2, 3))
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        point = np.where(size == 2, (lead & 0x1F) << 6 | one, np.where(size == 3, (lead & 0x0F) << 12 | one << 6 | two, (lead & 0x07) << 18 | one << 12 | two << 6 | three))
        kind = kinds[np.minimum(point, 0x10FFFF)]
        out[at] = kind
        for k in (1, 2, 3):
            more = size > k
            out[at[more] + k] = kind[more]
    return out


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its word, document of each word, letters of each document): n-grams of 2, 3 and 4 bytes
    that end at a letter or at the edge behind a word. Letters are counted by their bytes."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    kind = _kinds_of(data)
    # an edge before and behind each text, so that n-grams never join two
    at = np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offsets))
    line = np.zeros(len(data) + n + 1, np.uint8)
    line[at] = np.where(kind > 0, _LOWER[data], 0)
    edge = line == 0
    head = np.flatnonzero(~edge[1:] & edge[:-1]) + 1
    word = np.cumsum(~edge & np.r_[True, edge[:-1]], dtype=np.int32) - 1
    ends = offsets[1:] + np.arange(1, n + 1)
    word_doc = np.searchsorted(ends, head, "right")
    wide = line.astype(np.uint32)
    two = wide.copy()
    two[1:] |= wide[:-1] << 8
    three = two.copy()
    three[2:] |= wide[:-2] << 16
    four = three.copy()
    four[3:] |= wide[:-3] << 24
    # at a letter the word has begun; at the edge behind a word it still counts for that word
    live = np.flatnonzero(~edge | np.r_[False, ~edge[:-1]])
    inner = live[~edge[np.maximum(live - 1, 0)]]
    deep = inner[~edge[np.maximum(inner - 2, 0)]]
    codes, of = [], []
    for k, (code, where) in enumerate(((two, live), (three, inner), (four, deep))):
        codes.append((mix(code[where].astype(np.uint64) + (np.uint64(k + 1) << np.uint64(40))) >> np.uint64(48)).astype(np.int64))
        of.append(word[where])
    letters = np.add.reduceat(np.r_[kind == 1, False].astype(np.int64), offsets[:-1])
    letters[offsets[1:] == offsets[:-1]] = 0
    return np.concatenate(codes), np.concatenate(of), word_doc, letters


def _parts(texts: pa.Array, most: int = CHUNK) -> Iterator[pa.Array]:
    """texts, or the parts of a single one that is longer, cut behind a blank where there is one."""
    if len(texts) != 1 or texts.nbytes <= most or not texts[0].is_valid:
        yield texts
        return
    text = texts[0].as_buffer().to_pybytes()
    a = 0
    while a < len(text):
        b = min(a + most, len(text))
        if b < len(text):
            blank = text.rfind(b" ", a, b)
            b = blank + 1 if blank > a else b
            while b < len(text) and text[b] & 0xC0 == 0x80:
                b += 1
        yield pa.array([text[a:b].decode()])
        a = b


def learn(docs: DataFrame, folds: int = 3, held: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each bucket in each language. All texts of the learning folds with
    a language count; what comes to the driver is a row of counts for each of LANGUAGES languages at most."""
    seen = docs.where("lang is not null and text is not null").where(fold(F.col("doc_id"), folds) != held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for name, row in sums.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "bucket", "n"])
            sums.clear()

        for b in pieces(batches):
            langs = b.column(0).dictionary_encode()
            names = langs.dictionary.to_pylist()
            for texts in _parts(b.column(1)):
                code, word, doc, _ = grams(texts)
                of = np.asarray(langs.indices)[doc][word].astype(np.int64) if len(word) else np.empty(0, np.int64)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + np.bincount(code[of == k], minlength=BUCKETS)
            if len(sums) > LANGUAGES:
                yield from flush(sums)
        yield from flush(sums)

    counts = seen.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    with scratch():
        counts = materialize(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
        most = counts.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.col("all").desc(), "lang").limit(LANGUAGES)
        counts = counts.join(most, "lang").select("lang", "bucket", "n").toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()), key=lambda x: x.encode())
    at = {name: k for k, name in enumerate(langs)}
    table = np.zeros((len(langs), BUCKETS))
    table[[at[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    table += 0.5
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, times: np.ndarray, first: np.ndarray, doc: np.ndarray, share: np.ndarray, steps: int = _STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages, from those at the start, and log-likelihood, for each document. like: (words, languages)
    scaled; times: how often each word stands in its document."""
    for _ in range(steps):
        part = share[doc]
        part *= like
        total = np.maximum(part @ np.ones(part.shape[1], part.dtype), 1e-30)
        part *= (times / total)[:, None]
        share = np.add.reduceat(part, first, axis=0)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
    return share, np.add.reduceat(times * np.log(total, dtype=np.float64), first)


def _words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, number that equal words share, times, log-likelihoods) of the different words of each document, by document;
    and the letters of each document."""
    code, word, word_doc, letters = grams(texts)
    if not len(word_doc):
        return word_doc, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, len(table)), np.float32), letters
    order = np.argsort(word, kind="stable")
    code = code[order]
    begins = np.searchsorted(word[order], np.arange(len(word_doc)))
    sizes = np.diff(np.r_[begins, len(code)])
    with np.errstate(over="ignore"):
        same = np.add.reduceat(mix(code.astype(np.uint64) + np.uint64(0xABCDEF)), begins) + mix(sizes.astype(np.uint64))
    order = within(word_doc, same)
    new = np.ones(len(order), bool)
    new[1:] = (same[order][1:] != same[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
    start = np.flatnonzero(new)
    one = order[start]
    times = np.diff(np.r_[start, len(order)])
    # the n-grams of one word of each kind
    sizes = sizes[one]
    to = np.cumsum(sizes)
    at = np.arange(to[-1]) + np.repeat(begins[one] - (to - sizes), sizes)
    code = code[at]
    log = np.column_stack([np.add.reduceat(row[code], to - sizes) for row in table])
    return word_doc[one], same[one], times, log, letters


def mixture(texts: pa.Array, table: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number or -1, its share, number of languages in the set) for each text. Works on a part of CHUNK bytes of a
    long text at a time; what stays is a row for each different word."""
    n, many = len(texts), len(table)
    best, score, size = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
    parts = [_words(part, table) for part in _parts(texts)]
    doc_of, same, times, log = (np.concatenate([p[k] for p in parts]) for k in range(4))
    letters = parts[0][4] if len(parts) == 1 else np.array([sum(int(p[4][0]) for p in parts)])
    if len(parts) > 1:
        _, at, back = np.unique(same, return_index=True, return_inverse=True)
        doc_of, log, times = doc_of[at], log[at], np.bincount(back, times)
    if not len(doc_of) or not many:
        return best, score, size
    # n-grams of a word overlap, so that their evidence is tempered
    like = np.exp(_TEMPER * (log - log.max(1, keepdims=True))).astype(np.float32)
    times = times.astype(np.float32)
    rows, first, doc = np.unique(doc_of, return_index=True, return_inverse=True)
    words = np.add.reduceat(times, first)
    share, _ = _em(like, times, first, doc, np.full((len(rows), many), 1 / many, np.float32))
    rank = np.argsort(-share, axis=1, kind="stable")
    keep, worth = np.zeros((len(rows), many)), np.full(len(rows), -np.inf)
    live = np.arange(len(rows))
    for k in range(1, many + 1):
        # documents that gained nothing from the language before are done
        mine = np.isin(doc, live) if len(live) < len(rows) else np.ones(len(doc), bool)
        at, inner, local = np.unique(doc[mine], return_index=True, return_inverse=True)
        top = rank[at, :k]
        got, total = _em(np.take_along_axis(like[mine], top[local], 1), times[mine], inner, local, np.full((len(at), k), 1 / k, np.float32), 1 if k == 1 else _STEPS)
        total -= penalty * (k - 1) * np.log(words[at] + 1)
        better = total > worth[at] + 1e-9
        live = at[better]
        if not len(live):
            break
        keep[live] = 0
        keep[live[:, None], top[better]] = got[better]
        worth[live] = total[better]
        size[rows[live]] = k
    best[rows], score[rows] = keep.argmax(1), keep.max(1)
    best[letters == 0], score[letters == 0], size[letters == 0] = -1, 0, 0
    return best, np.clip(score, 0, 1), size


def predict(docs: DataFrame, folds: int = 3, held: int = 1, penalty: float = 1.0) -> DataFrame:
    """docs: doc_id, text, lang. A row for each input row: doc_id, held_out, lang_pred, score (the share of that language),
    n_langs (size of the set chosen).

    A null text or one without a letter (Unicode category L) is `und` with score 0, and so is every text if nothing could be learned. Of
    languages with equal shares the first in code-point order is taken; rows that repeat are predicted alike.
    """
    langs, table = learn(docs, folds, held)
    names = pa.array([*langs, "und"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            best, score, size = mixture(b.column(1), table, penalty)
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(np.where(best < 0, len(langs), best))), pa.array(score), pa.array(size)], ["doc_id", "lang_pred", "score", "n_langs"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_langs long")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", "n_langs")
