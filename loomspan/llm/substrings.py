"""Repeated passages, by compressed FM-indexes of routed shards.

A window is `window` words in a row. Every window has a smallest word GRAM by hash; windows in a row with the same one
make a run, and equal windows always have the same gram, so that the gram routes them to one shard. A gram that occurs once in
the corpus, outside a run that has it twice, can't be in a repeated window: its run isn't sent. Each shard builds FM-indexes of
its distinct runs and streams all of them through backward search: a window that a maximal match covers is repeated, where the
match is to occur twice or, for a run that stands in several places, once. The words of runs are fetched only for these. The
windows of a gram with very many different runs are routed one by one, by the grams at their ends too, each different one
once or twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import materialize, tidy
from loomspan.llm.fmindex import FMIndex
from loomspan.llm.words import _WORDS, Words, mix, pieces

GRAM = 8
#: Words of an index; different runs of a gram above which its windows are routed one by one.
INDEX, MANY = 1 << 19, 4096


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` values in a row."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - done :][: len(values) - width + 1])


def _runs(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, gram, hash of the run's words, whether a gram repeats within reach) of each run."""
    gram, _, first = words.grams(GRAM)
    wide = window - GRAM + 1
    many = np.maximum(words.count - window + 1, 0)
    total = int(many.sum())
    if not total:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty.astype(bool)
    base = np.cumsum(many) - many
    doc = np.repeat(np.arange(len(many)), many)
    turn = np.arange(total) - base[doc]
    least = _least(gram, wide)[first[doc] + turn]
    new = np.ones(total, bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, total])
    up, down = _WORDS.upto(len(words.hash) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words.hash) + 1, np.uint64)
        np.cumsum(words.hash * up[: len(words.hash)], out=sums[1:])
        a = words.first[doc[at]] + turn[at]
        b = a + n + window - 1
        run = mix((sums[b] - sums[a]) * down[a] + n.astype(np.uint64))
    # two equal windows of one run have its gram twice, less than a window apart
    again = np.zeros(len(gram) + 1, bool)
    for far in range(1, wide + 1):
        again[: max(0, len(gram) - far)] |= gram[far:] == gram[:-far]
    known = np.r_[0, np.cumsum(again)]
    a = first[doc[at]] + turn[at]
    return doc[at], turn[at], n, least[at], run, known[a + n + wide - 1] > known[a]


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            doc, at, n, gram, whole, own = _runs(Words(b.column(1)), window)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(own)], ["tid", "at", "n", "gram", "run", "own"])

    return docs.select("tid", "text").mapInArrow(run, "tid long, at int, n int, gram long, run long, own boolean")


def _fetch(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted runs, or of the windows of hot ones: (shard, gram, run, base, copies, hot, words). docs has a
    text for each tid, or copies of it, of which a task takes one."""
    lists = wanted.groupBy("tid").agg(F.collect_list(F.struct("at", "n", "gram", "run", "copies", "hot")).alias("runs"))
    both = docs.select("tid", "text").join(lists, "tid")
    fields = pa.schema([("shard", pa.int64()), ("gram", pa.int64()), ("run", pa.int64()), ("base", pa.int32()), ("copies", pa.int32()), ("hot", pa.bool_()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches):
            tids = b.column(0).to_pylist()
            new = [k for k, t in enumerate(tids) if t not in seen and not seen.add(t)]
            b = b.take(pa.array(new, pa.int64()))
            words = Words(b.column(1))
            grams, _, first = words.grams(GRAM)
            rows = []
            for k, runs in enumerate(b.column(2).to_pylist()):
                begin = int(words.first[k])
                for r in runs:
                    a = begin + r["at"]
                    if not r["hot"]:
                        rows.append((r["gram"], r["gram"], r["run"], 0, r["copies"], False, words.hash[a : a + r["n"] + window - 1].tobytes()))
                        continue
                    for w in range(r["n"]):
                        at = first[k] + r["at"] + w
                        shard = mix(np.array([r["gram"]]).view(np.uint64) ^ mix(grams[at] ^ mix(grams[at + window - GRAM]))).view(np.int64)[0]
                        rows.append((int(shard), r["gram"], r["run"], w, r["copies"], True, words.hash[a + w : a + w + window].tobytes()))
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return both.select("tid", "text", "runs").mapInArrow(run, "shard long, gram long, run long, base int, copies int, hot boolean, words binary")


def repeated_windows(texts: list[np.ndarray], copies: list[int], window: int) -> list[np.ndarray]:
    """For each text of word hashes the windows that occur more than once in all the texts, of which each stands in so many
    places (2: or more): all are streamed through the index, or through an index for each INDEX words of texts."""
    sizes = np.cumsum([len(t) + 1 for t in texts])
    cuts = sorted({0, *(int(np.searchsorted(sizes, x, "right")) for x in range(INDEX, int(sizes[-1]), INDEX)), len(texts)})
    flat = np.concatenate(texts)
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    times = np.array(copies)

    def index_of(a: int, b: int) -> tuple[FMIndex, np.ndarray]:
        vocabulary, number = np.unique(flat[first[a] : first[b]], return_inverse=True)
        return FMIndex([number[first[k] - first[a] : first[k + 1] - first[a]] + 1 for k in range(a, b)]), vocabulary

    if len(cuts) == 2:
        index, vocabulary = index_of(0, len(texts))
        hit = index.covered(np.searchsorted(vocabulary, flat) + 1, first[:-1], first[1:], window, np.maximum(1, 3 - times))
        return [np.flatnonzero(hit[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    ends = np.concatenate([np.arange(a + window, b + 1) for a, b in zip(first[:-1], first[1:], strict=True)])
    owner = np.repeat(np.arange(len(texts)), np.maximum(np.diff(first) - window + 1, 0))
    total = times[owner] - 1
    for a, b in zip(cuts, cuts[1:], strict=False):
        index, vocabulary = index_of(a, b)
        at = np.searchsorted(vocabulary, flat)
        at[at == len(vocabulary)] = 0
        # a word that isn't in this index gets a symbol that occurs nowhere
        index.starts = np.r_[index.starts, index.starts[-1]]
        text = np.where(vocabulary[at] == flat, at + 1, len(vocabulary) + 1)
        known = np.cumsum(np.r_[0, text > len(vocabulary)])
        inside = known[ends] == known[ends - window]
        once = index.statistics(text, ends[inside], window, 1) >= window
        twice = index.statistics(text, ends[inside], window, 2) >= window
        total[inside] += once.astype(np.int64) + twice
    again = np.split(total >= 2, np.cumsum(np.maximum(np.diff(first) - window + 1, 0))[:-1])
    return [np.flatnonzero(x) for x in again]


def _search(shards: DataFrame, window: int) -> DataFrame:
    """shards: (shard, gram, run, base, copies, words), a shard's rows together, equal runs side by side. Repeated windows as
    (gram, run, a, b)."""
    fields = pa.schema([("gram", pa.int64()), ("run", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last, shard = 0, None, None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            found = repeated_windows([x[3] for x in held], [x[4] for x in held], window)
            rows = []
            for (gram, whole, base, _, _), w in zip(held, found, strict=True):
                if len(w):
                    cut = np.flatnonzero(np.diff(w) > 1)
                    for a, b in zip(w[np.r_[0, cut + 1]], w[np.r_[cut, len(w) - 1]], strict=True):
                        rows.append((gram, whole, base + int(a), base + int(b) + 1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

        for b in batches:
            for s, gram, whole, base, copies, words in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if s != shard and size >= INDEX // 2:
                    yield from close()
                    held, size = [], 0
                shard = s
                if (gram, whole, base) == last:  # a copy of the text gave the same run again
                    continue
                last = (gram, whole, base)
                held.append((gram, whole, base, np.frombuffer(words, np.uint64), copies))
                size += len(words) // 8
        yield from close()

    return shards.mapInArrow(run, "gram long, run long, a int, b int")


def _cover(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """Removes the words that repeated windows cover."""
    lists = spans.groupBy("tid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    both = docs.join(lists, "tid", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(1))
            edge = np.zeros(len(words.hash) + 1, np.int64)
            for k in np.flatnonzero(np.asarray(b.column(2).is_valid())):
                for s in b.column(2)[int(k)].as_py():
                    edge[words.first[k] + s["a"]] += 1
                    edge[words.first[k] + s["b"] - 1 + window] -= 1
            kept = np.cumsum(edge)[:-1] == 0
            doc = words.doc()
            start, size = words.start[kept], words.end[kept] - words.start[kept] + 1
            ends = np.cumsum(size)
            source = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)
            out = words.data[np.minimum(source, max(0, len(words.data) - 1))]
            out[ends - 1] = 0x20
            left = np.bincount(doc[kept], minlength=len(words.count))
            stop = np.cumsum(left)
            # a document's last blank goes
            full = np.flatnonzero(left)
            last = ends[stop[full] - 1] - 1
            out = np.delete(out, last)
            sizes = np.zeros(len(left), np.int64)
            sizes[full] = np.diff(np.r_[0, last + 1]) - 1
            offsets = np.r_[0, np.cumsum(sizes)]
            text = pa.Array.from_buffers(pa.large_string(), len(left), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.count), pa.array(words.count - left), text.cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, text string")


@tidy
def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs: doc_id, text. A row for each input row: doc_id, n_words, n_removed, text (the words kept, a blank between).

    Words are runs of non-blanks, unchanged. A word goes if a window that covers it also starts anywhere else, in the same
    text or another; a row that repeats is another text. Null and empty texts have no words, and texts shorter than a
    window lose none. Windows are compared by 64-bit hashes of their words. An empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    seed = 0
    while True:  # texts go by a hash; one that tells all of them apart
        tid = F.xxhash64(F.lit(seed), "text")
        seen = base.select(tid.alias("tid"), F.xxhash64(F.lit(seed + 1), F.length("text"), "text").alias("check"))
        if seen.groupBy("tid").agg((F.min("check") != F.max("check")).alias("mixed")).where("mixed").isEmpty():
            break
        seed += 2
    base = base.withColumn("tid", tid)
    occurring = _occurrences(base, window)
    often = occurring.groupBy("gram").agg(F.count(F.lit(1)).alias("many"), F.max("own").alias("twice")).where("many > 1 or twice")
    near = materialize(occurring.join(often.select("gram"), "gram", "left_semi"), "runs")
    runs = near.groupBy("gram", "run", "n").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("tid", "at")).alias("where"))
    runs = materialize(runs.select("gram", "run", "n", "where.tid", "where.at", F.least("times", F.lit(2)).cast("int").alias("copies")), "kinds")
    hot = materialize(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > MANY).select("gram", F.lit(True).alias("is_hot")), "hot")
    wanted = runs.join(hot, "gram", "left").withColumn("hot", F.coalesce("is_hot", F.lit(False)))
    rows = _fetch(base, wanted, window)
    split = hot.limit(1).count() > 0
    rows = materialize(rows, "words") if split else rows
    columns = ["shard", "gram", "run", "base", "copies", "words"]
    cold = rows.where("not hot").select(*columns)
    found = _search(cold.repartition("shard").sortWithinPartitions("shard", "gram", "run", "base"), window)
    if split:
        each = rows.where("hot").dropDuplicates(["gram", "run", "base"]).withColumn("same", F.xxhash64("words"))
        kinds = each.groupBy("shard", "same", "words").agg(F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"))
        kinds = kinds.select("shard", F.col("shard").alias("gram"), F.col("same").alias("run"), F.lit(0).alias("base"), "copies", "words")
        many = _search(kinds.repartition("shard").sortWithinPartitions("shard", "gram", "run", "base"), window)
        many = each.join(many.select(F.col("gram").alias("shard"), F.col("run").alias("same")), ["shard", "same"])
        found = found.unionAll(many.select("gram", "run", F.col("base").alias("a"), (F.col("base") + 1).alias("b")))
    found = materialize(found, "repeats")
    spans = near.join(found, ["gram", "run"]).select("tid", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    return _cover(base, spans, window)
