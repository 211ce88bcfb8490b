"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then verification.

The benchmark is small and is what is indexed; the corpus is the stream of queries. An item is cut into pieces of at
most PIECE words, each a document of the index; a posting's impact is its BM25 weight divided by the piece's score
against itself, so that one threshold holds for all pieces. Document frequencies and the mean length are those of the whole
benchmark, however many parts it is held in. Pieces are numbered by what frequent terms give them, and BLOCK neighbours are a
block; a posting list has its greatest impact overall and in each block where it has a posting, and no entry elsewhere.
Every passage of a training text (2 * PIECE words, each PIECE words) is a query. For all passages of a batch at once it is
asked whether any block could reach the threshold: rare terms by their block maxima and frequent ones by the most that a
piece of the block gets from all of them, then by their own block maxima. Where one could, block-max WAND walks the passage's
posting lists: the pivot is the first piece at which the lists' maxima reach the threshold; if its block's maxima don't, the
lists skip to the block's end; else the piece is scored. Retrieved pairs are verified: the word 3-grams of the item's
question and of its answer must occur near the passage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from loomspan.llm.common import materialize, scratch
from loomspan.llm.words import Words, pieces

PIECE, BLOCK, GRAM = 32, 16, 3
#: Passages whose block bounds are held at a time.
STRIDE = 4096
K1, B = 1.2, 0.75
#: A term of more than this share of the pieces is frequent.
FREQUENT = 0.05
#: Items and bytes of benchmark that one pass over the corpus holds; a larger benchmark takes several passes.
ITEMS, BYTES = 4096, 8 << 20


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(out) + k]) * np.uint64(0x9DDFEA08EB382D69) + np.uint64(n)
    return out


def _answer_at(text: str, words: int) -> int:
    """The item's words from here on are its answer: its last sentence, or its last quarter if it has only one."""
    cut = max(text.rstrip(" .!?\n").rfind(x) for x in (". ", "? ", "! ", "\n", ".\n"))
    before = len(Words(pa.array([text[: cut + 1]]), plain=True).hash) if cut >= 0 else 0
    return before if 0 < before < words else max(1, words - max(1, words // 4))


@dataclass
class Stats:
    """Of the whole benchmark: its pieces, their mean length, and in how many of them each term of some part stands."""

    pieces: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def _cut(h: np.ndarray) -> list[np.ndarray]:
    """An item's pieces."""
    return np.array_split(h, -(-len(h) // PIECE)) if len(h) else []


class Index:
    def __init__(self, ids: list, texts: list[str], stats: Stats | None = None) -> None:
        words = Words(pa.array(texts, pa.string()), plain=True)
        self.ids, self.question, self.answer, self.length = [], [], [], []
        owner, parts = [], []
        for k, (item, text) in enumerate(zip(ids, texts, strict=True)):
            h = words.hash[words.first[k] : words.first[k + 1]]
            if not len(h):
                continue
            cut = _answer_at(text, len(h))
            self.question.append(np.unique(_runs(h[:cut], min(GRAM, cut))))
            self.answer.append(np.unique(_runs(h[cut:], min(GRAM, len(h) - cut))))
            self.length.append(len(h))
            for part in _cut(h):
                owner.append(len(self.ids))
                parts.append(part)
            self.ids.append(item)
        self.pieces = len(parts)
        many = max(1, self.pieces)
        piece = np.repeat(np.arange(self.pieces), [len(x) for x in parts])
        self.terms, term = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_inverse=True)
        pair, tf = np.unique(term * many + piece, return_counts=True)
        post_term, post_piece = pair // many, pair % many
        size = np.bincount(piece, minlength=self.pieces)
        if stats is None:
            stats = Stats(self.pieces, float(size.mean()) if len(size) else 1.0, self.terms, np.bincount(post_term, minlength=len(self.terms)))
        df = stats.df[np.searchsorted(stats.terms, self.terms)]
        idf = np.log1p((stats.pieces - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(1e-9, stats.mean))
        weight = idf[post_term] * tf * (K1 + 1) / (tf + norm[post_piece])
        impact = weight / np.bincount(post_piece, weight, minlength=self.pieces)[post_piece]
        # frequent terms are bounded together first: by the most that any piece of the block can get from them
        self.frequent = np.r_[df > np.maximum(FREQUENT * stats.pieces, 2), True]
        usual = np.bincount(post_piece, impact * self.frequent[post_term], minlength=self.pieces)
        order = np.argsort(usual, kind="stable")
        number = np.empty(self.pieces, np.int64)
        number[order] = np.arange(self.pieces)
        self.owner = np.array(owner, np.int64)[order]
        # postings by term and piece, and block maxima by term and block
        by = np.lexsort((number[post_piece], post_term))
        self.post_term, self.post_piece, self.impact = post_term[by], number[post_piece][by], impact[by]
        self.first = np.searchsorted(self.post_term, np.arange(len(self.terms) + 1))
        self.blocks = -(-self.pieces // BLOCK)
        key = self.post_term * max(1, self.blocks) + self.post_piece // BLOCK
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.max_key = key[start]
        self.max_block, max_term = self.max_key % max(1, self.blocks), self.max_key // max(1, self.blocks)
        self.max_impact = np.maximum.reduceat(self.impact, start) if len(key) else np.empty(0)
        self.max_first = np.searchsorted(max_term, np.arange(len(self.terms) + 1))
        self.usual = np.zeros(self.blocks)
        np.maximum.at(self.usual, np.arange(self.pieces) // BLOCK, usual[order])
        # the same lists for the walk
        self.lists = [x.tolist() for x in np.split(self.post_piece, self.first[1:-1])] if len(self.terms) else []
        self.values = [x.tolist() for x in np.split(self.impact, self.first[1:-1])] if len(self.terms) else []
        self.most = [max(x) for x in self.values]
        cuts = self.max_first[1:-1]
        self.in_block = [dict(zip(x.tolist(), y.tolist(), strict=True)) for x, y in zip(np.split(self.max_block, cuts), np.split(self.max_impact, cuts), strict=True)] if len(self.terms) else []

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """Number of each word's term; len(terms) for others."""
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, len(self.terms)) if len(self.terms) else np.zeros(len(h), np.int64)

    def walk(self, terms: list[int], threshold: float) -> Iterator[tuple[int, float]]:
        """(piece, score) of every piece whose score by these terms is the threshold or more: block-max WAND."""
        floor = threshold - 1e-9
        live = [[self.lists[t][0], 0, t] for t in terms]  # current piece, its place in the list, term
        while live:
            live.sort()
            total, pivot = 0.0, -1
            for piece, _, t in live:
                total += self.most[t]
                if total >= floor:
                    pivot = piece
                    break
            if pivot < 0:
                return
            block = pivot // BLOCK
            bound, after = 0.0, (block + 1) * BLOCK
            for piece, _, t in live:
                if piece > pivot:
                    after = min(after, piece)
                    break
                bound += self.in_block[t].get(block, 0.0)
            if bound >= floor:
                score = 0.0
                for piece, at, t in live:
                    if piece > pivot:
                        break
                    k = bisect_left(self.lists[t], pivot, at)
                    if k < len(self.lists[t]) and self.lists[t][k] == pivot:
                        score += self.values[t][k]
                if score >= floor:
                    yield pivot, score
                after = pivot + 1
            moved = []
            for one in live:
                piece, at, t = one
                if piece < after:
                    at = bisect_left(self.lists[t], after, at)
                    if at == len(self.lists[t]):
                        continue
                    one = [self.lists[t][at], at, t]
                moved.append(one)
            live = moved

    def _hopeful(self, at: np.ndarray, hit: np.ndarray, usual: np.ndarray, frequent: np.ndarray, n: int, floor: float) -> np.ndarray:
        """Passages that some block's bound lets pass. (at, hit): passages and their rare terms; (usual, frequent): and their
        frequent ones. STRIDE passages at a time, so that the table of passages and blocks stays small."""
        out = []
        for low in range(0, n, STRIDE):
            many = min(STRIDE, n - low)
            a, b = np.searchsorted(at, [low, low + many])
            span = self.max_first[hit[a:b] + 1] - self.max_first[hit[a:b]]
            entry = np.arange(span.sum()) + np.repeat(self.max_first[hit[a:b]] - (np.cumsum(span) - span), span)
            where = np.repeat(at[a:b] - low, span) * self.blocks + self.max_block[entry]
            rare = np.bincount(where, self.max_impact[entry], minlength=many * self.blocks).reshape(many, self.blocks)
            passage, block = np.nonzero(rare + self.usual >= floor)
            # frequent terms one by one, for these alone
            a, b = np.searchsorted(usual, [passage + low, passage + low + 1])
            pair = np.repeat(np.arange(len(passage)), b - a)
            term = frequent[np.arange(len(pair)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)]
            key = term * self.blocks + block[pair]
            found = np.minimum(np.searchsorted(self.max_key, key), len(self.max_key) - 1)
            more = np.bincount(pair, np.where(self.max_key[found] == key, self.max_impact[found], 0.0), minlength=len(passage))
            out.append(np.unique(passage[rare[passage, block] + more >= floor]) + low)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def retrieve(self, words: Words, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, last word + 1, score) of every passage and piece at or above the threshold."""
        if not self.blocks or not len(words.hash):
            return
        every, doc = self.term_of(words.hash), words.doc()
        known = np.flatnonzero(every < len(self.terms))
        term, doc = every[known], doc[known]
        turn = (known - words.first[doc]) // PIECE  # the passage that starts in the word's own stretch
        order = np.argsort(doc * (len(self.terms) + 1) + term, kind="stable")
        again = (doc[order][1:] == doc[order][:-1]) & (term[order][1:] == term[order][:-1])
        gap = np.full(len(term), 2, np.int64)  # stretches since the term came last in this text, 2 and more alike
        gap[order[1:][again]] = (turn[order[1:]] - turn[order[:-1]])[again]
        many = np.where(words.count > 0, np.maximum(1, -(-(words.count - PIECE) // PIECE)), 0)
        base = np.cumsum(many) - many
        row = np.repeat(np.arange(len(many)), many)
        start = words.first[row] + (np.arange(len(row)) - base[row]) * PIECE
        end = np.minimum(start + 2 * PIECE, words.first[row + 1])
        # a word counts in the passage of its stretch, and in the one before, unless the term has come there already
        own, last = (gap > 0) & (turn < many[doc]), (gap > 1) & (turn > 0)
        at = np.r_[(base[doc] + turn)[own], (base[doc] + turn - 1)[last]]
        hit = np.r_[term[own], term[last]]
        order = np.argsort(at, kind="stable")
        at, hit = at[order], hit[order]
        usual = self.frequent[hit]
        for w in self._hopeful(at[~usual], hit[~usual], at[usual], hit[usual], len(row), threshold - 1e-6).tolist():
            a, b = np.searchsorted(at, [w, w + 1])
            for piece, score in self.walk(np.unique(hit[a:b]).tolist(), threshold):
                yield int(row[w]), int(self.owner[piece]), int(start[w]), int(end[w]), score

    def leaks(self, words: Words, threshold: float, question: float, answer: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item id) -> (score, question overlap, answer overlap), verified; the best passage counts."""
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for row, item, a, b, score in self.retrieve(words, threshold):
            reach = self.length[item]
            a, b = max(words.first[row], a - reach), min(words.first[row + 1], b + reach)
            near = words.hash[a:b]
            here = np.concatenate([_runs(near, n) for n in range(1, GRAM + 1)])
            q, r = (float(np.isin(of, here).mean()) if len(of) else 1.0 for of in (self.question[item], self.answer[item]))
            if q >= question and r >= answer:
                key = (row, self.ids[item])
                found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (score, q, r))
        return found


@scratch()
def _stats(items: DataFrame, parts: int) -> list[Stats]:
    """Statistics of the whole benchmark, with the document frequencies of each part's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(1), plain=True)
            cut = [_cut(words.hash[x:y]) for x, y in zip(words.first[:-1], words.first[1:], strict=True)]
            for part, of in zip(b.column(0).to_pylist(), cut, strict=True):
                for piece in of:
                    terms = np.unique(piece).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), part, np.int32)), pa.array(terms), pa.array(np.full(len(terms), len(piece))), pa.array(np.arange(len(terms)) == 0)], ["part", "term", "words", "head"])

    seen = materialize(items.select("part", "text").mapInArrow(run, "part int, term long, words long, head boolean"), "benchmark")
    total, mean = seen.where("head").agg(F.count(F.lit(1)), F.avg("words")).first()
    df = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    of = materialize(seen.select("part", "term").distinct().join(df, "term"), "terms")
    out = []
    for k in range(parts):
        table = of.where(F.col("part") == k).select("term", "df").toArrow()
        terms, counts = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
        order = np.argsort(terms)
        out.append(Stats(total, mean or 1.0, terms[order], counts[order]))
    return out


def indexes(benchmark: DataFrame) -> list[Index]:
    """One index, or several of bounded size if the benchmark is large; scores are the same either way. Null texts have no
    words and match nothing."""
    items = benchmark.where("text is not null").select("item_id", "text")
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-count // ITEMS), -(-size // BYTES))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    stats = _stats(items, parts) if parts > 1 else [None]
    out = []
    for k in range(parts):
        table = items.where(F.col("part") == k).orderBy("item_id", "text").toArrow()
        out.append(Index(table.column("item_id").to_pylist(), table.column("text").to_pylist(), stats[k]))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.6, answer: float = 0.5) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. A row for each document and item that it holds: doc_id, item_id,
    score (BM25 as a share of the item's score against itself), question_overlap, answer_overlap. Rows that repeat are
    reported each; null and empty texts hold nothing; an empty benchmark gives an empty result.
    """
    kinds = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("item_id", benchmark.schema["item_id"].dataType)])
    schema = StructType([*kinds, *(StructField(c, DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))])
    fields = to_arrow_schema(schema)

    def one(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                found = index.leaks(Words(b.column(1), plain=True), threshold, question, answer)
                if found:
                    ids = b.column(0).to_pylist()
                    rows = [(ids[row], item, *rest) for (row, item), rest in found.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    parts = [one(index) for index in indexes(benchmark)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.6, answer: float = 0.5) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns as they were, whatever their names. Null and empty texts stay;
    rows that repeat stay or go together; an empty benchmark takes nothing away."""
    out = docs
    for index in indexes(benchmark):
        names = [f"c{i}" for i in range(len(docs.columns))]
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], index=index, at=at) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, f"c{at}"):
                hit = {row for row, _ in index.leaks(Words(b.column(at), plain=True), threshold, question, answer)}
                yield b.filter(pa.array([k not in hit for k in range(b.num_rows)])) if hit else b

        plain = out.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
        out = plain.mapInArrow(run, plain.schema).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
    return out
