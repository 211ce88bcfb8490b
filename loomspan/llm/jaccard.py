"""Near-duplicate documents by the Jaccard similarity of their word shingles, through R-trees of count vectors.

Points. A document's set of shingles is hashed into groups; the counts of the groups are its point. Two sets share at most
the sum, over the groups, of the smaller count. R-trees of points are joined under that bound; the sets of the pairs that
survive are compared. Texts with equal sets take part once.

Partitioning. A tree is built for every key that several sets share. Keys are a prefix of each set in one global order of
shingles, rare ones first: a set of n emits n - ceil(t n) + 1 + n // SPARE of them, and may then forget its most frequent
n' // SPARE keys, n' = ceil(t n) being the least partner's size: of two linked sets' common keys one is left. The order comes
from a count of all shingles by cell, heaviest cells last; any order gives the same result. A map task sends each key once,
with the least of its sets, whatever their number there; the others follow only where the key is shared.

Rounds. (1) Each set goes to one home, the set that most of its keys name as their least, and the trees of the homes give
groups that surviving pairs connect. (2) Keys whose sets lie in several groups get trees of their own, in which pairs of one
group are skipped; the groups then hold every surviving pair. (3) A group's texts meet once: a tree again, whose surviving
pairs are compared exactly, and pairs that links connect already are skipped. Groups larger than MOST sets or WEIGHT
shingles meet in chunks, each with the group's first set. (4) Of such groups the keys that still hold several components get
trees and exact comparisons. A surviving pair needn't be a link, so it joins its two sets here and not their components: what
else the components hold is still asked for. No step makes rows of pairs: trees give a spanning forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm.common import components, materialize, tidy
from loomspan.llm.rtree import CountTree
from loomspan.llm.words import Words, by_pairs, mix, pieces, whole_hash, within

#: Sets, and shingles, that a task holds for either side of a join.
MOST, WEIGHT = 4096, 1 << 21
#: One key in so many may be forgotten.
SPARE = 32
#: Cells that shingles are counted by; keys that a map task gathers before it sends them; keys of a reduce task, about.
CELLS, FLUSH, DEALT = 1 << 18, 1 << 19, 1 << 21
#: A coordinate of 4 bits that says no more than that the group may hold the whole set.
OPEN = 15


def sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and n + 1 offsets."""
    words = Words(texts, lower=True)
    h, _, first = words.grams(shingle)
    d = np.repeat(np.arange(len(words.count)), np.diff(first))
    short = np.flatnonzero((words.count > 0) & (words.count < shingle))
    h, d = np.r_[h, whole_hash(words, short)], np.r_[d, short]
    order = within(d, h)
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(words.count) + 1))


def _sums(h: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        run = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)]
        return (run[first[1:]] - run[first[:-1]]).view(np.int64)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64) & (CELLS - 1)


# points

def point(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by group, a group for each shingle at least, two counts to a byte."""
    width = max(16, 1 << (len(s) - 1).bit_length())
    counts = np.bincount((s >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width)
    counts = np.minimum(counts, OPEN).astype(np.uint8)
    return counts[0::2] | counts[1::2] << 4


def folded(p: np.ndarray, n: int, width: int) -> np.ndarray:
    """The counts of a point of a set of n, summed to fewer groups; a count that didn't fit counts as all of the set."""
    counts = np.empty(2 * len(p), np.int32)
    counts[0::2], counts[1::2] = p & 15, p >> 4
    counts[counts == OPEN] = n
    return counts.reshape(-1, width).sum(axis=0, dtype=np.int32)


@cache
def levels(num: int, den: int) -> np.ndarray:
    """First sizes of bands: linked sets are of one band or of neighbouring ones."""
    start = [1]
    while start[-1] < 1 << 40:
        start.append(start[-1] * den // num + 1)
    return np.array(start, np.int64)


def connect(points: list[np.ndarray], n: np.ndarray, label: np.ndarray, side: np.ndarray, num: int, den: int, accept: Callable[[int, int], bool] | None = None, apart: bool = False) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of rows of different labels, by R-trees of each band of sizes, joined with itself and with the next: those whose
    bound allows a link and that are accepted, as a forest, and what it connects. Of two sides only pairs across are asked.
    A pair connects all rows of its labels or, apart, its own two rows only."""
    labels = np.unique(label, return_inverse=True)[1]
    joined = np.arange(len(labels)) if apart else labels.copy()
    band, out = np.searchsorted(levels(num, den), n, "right"), []
    sides = np.unique(side)

    def tree(rows: np.ndarray, width: int) -> CountTree:
        return CountTree(np.stack([folded(points[r], int(n[r]), width) for r in rows.tolist()]), n[rows])

    for low in np.unique(band).tolist():
        here, above = band == low, band == low + 1
        if len(sides) == 1:
            joins = [(here, here), (here, above)]
        else:
            a, b = side == sides[0], side == sides[1]
            joins = [(here & a, here & b), (here & a, above & b), (here & b, above & a)]
        for x, y in joins:
            left, right = np.flatnonzero(x), np.flatnonzero(y)
            both = labels[np.r_[left, right]] if apart else joined[np.r_[left, right]]
            if not len(left) or not len(right) or (both == both[0]).all():
                continue
            width = 2 * min(len(points[r]) for r in (*left.tolist(), *right.tolist()))
            one = tree(left, width)
            two = one if x is y else tree(right, width)

            def skip(a: np.ndarray, b: np.ndarray, left=left, right=right) -> bool:
                for of in (joined, labels) if apart else (joined,):
                    first = of[left[a]]
                    if (first == first[0]).all() and (of[right[b]] == first[0]).all():
                        return True
                return False

            for a, b in one.join(two, num, den, skip):
                for i, j in zip(left[a].tolist(), right[b].tolist(), strict=True):
                    if joined[i] != joined[j] and labels[i] != labels[j] and (accept is None or accept(i, j)):
                        out.append((i, j))
                        joined[joined == joined[j]] = joined[i]
    return out, joined


# scans of the documents

def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and its point. Rows with n_shingles = -1 are a task's heavy cells: the
    number of a cell that holds over twice the task's average, as doc_id, and its count, as s1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(CELLS, np.int64)
        names = ["doc_id", "n_shingles", "s1", "s2", "point"]
        for b in pieces(batches):
            h, first = sets(b.column(1), shingle)
            load += np.bincount(_cell(h), minlength=CELLS)
            points = [point(h[x:y]).tobytes() if y > x else b"" for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), *(pa.array(_sums(h, first, x)) for x in (0x51, 0xC0FFEE)), pa.array(points, pa.binary())], names)
        heavy = np.flatnonzero(load > 4 + 2 * load.mean())
        none = pa.nulls(len(heavy), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(heavy), pa.array(np.full(len(heavy), -1)), pa.array(load[heavy]), pa.array(load[heavy]), none], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, point binary")


def _ranks(base: DataFrame) -> np.ndarray:
    """Rank of each cell in the order of shingles: the magnitude of what heavy cells hold, 0 for the others."""
    heavy = base.where("n_shingles < 0").groupBy("doc_id").agg(F.sum("s1").alias("load")).toArrow()
    rank = np.zeros(CELLS, np.uint8)
    rank[heavy.column(0).to_numpy()] = 1 + np.floor(np.log2(heavy.column(1).to_numpy()))
    return rank


def prefix(h: np.ndarray, first: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, documents): the first shingles of each set in the global order. Sets that only equal ones can be linked with
    have none."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    place = rank[_cell(h)].astype(np.uint64) << np.uint64(58) | mix(h) >> np.uint64(6)
    order = within(doc, place)
    most = np.where(den * n >= num * (n + 1), n + (num * n // -den) + 1 + n // SPARE, 0)
    keep = np.arange(len(h)) - first[:-1][doc] < most[doc]
    return h[order[keep]], doc[keep]


#: What a map task sends to a part, as arrays of 64-bit numbers: keys with their least set; the number of sets, for the keys at
#: these places, which have several; and the other sets of keys, with the least one.
PACKED = "part int, key binary, s1 binary, at binary, many binary, other binary, member binary, low binary"


def _keys(docs: DataFrame, shingle: int, num: int, den: int, rank: np.ndarray, parts: int) -> DataFrame:
    """PACKED rows. Of the sets of a key that a task holds at a time the least one goes to the key's part with their number,
    and the others, with the least one, to a part of their own."""

    def send(keys: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, s = np.concatenate(keys), np.concatenate(owners)
        order = by_pairs(k, s)
        k, s = k[order], s[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        new = np.ones(len(k), bool)
        new[1:] = ~same[1:] | (s[1:] != s[:-1])
        k, s, same = k[new], s[new], same[new]
        head = np.flatnonzero(~same)
        many = np.diff(np.r_[head, len(k)])
        low = np.repeat(s[head], many)[same]
        first, other = (k[head], s[head]), (k[same], s[same], low)
        to = (mix(first[0].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        to_other = (mix(other[0].view(np.uint64) ^ mix(low.view(np.uint64))) % np.uint64(parts)).astype(np.int32)
        order, order_other = np.argsort(to, kind="stable"), np.argsort(to_other, kind="stable")
        where = np.unique(np.r_[to, to_other])
        cut, cut_other = (np.searchsorted(t[o], np.r_[where, parts]) for t, o in ((to, order), (to_other, order_other)))
        rows = []
        for at, part in enumerate(where.tolist()):
            mine, its = order[cut[at] : cut[at + 1]], order_other[cut_other[at] : cut_other[at + 1]]
            several = np.flatnonzero(many[mine] > 1)
            rows.append((part, *(x[mine].tobytes() for x in first), several.tobytes(), many[mine][several].tobytes(), *(x[its].tobytes() for x in other)))
        columns = list(zip(*rows, strict=True))
        names = [c.split()[0] for c in PACKED.split(", ")]
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(columns[0][at : at + 256], pa.int32()), *(pa.array(c[at : at + 256], pa.binary()) for c in columns[1:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        for b in pieces(batches):
            h, first = sets(b.column(0), shingle)
            k, doc = prefix(h, first, rank, num, den)
            keys.append(k.view(np.int64))
            owners.append(_sums(h, first, 0x51)[doc])
            held += len(k)
            if held >= FLUSH:
                yield from send(keys, owners)
                keys, owners, held = [], [], 0
        if held:
            yield from send(keys, owners)

    return docs.where("doc_id is not null").select("text").mapInArrow(run, PACKED)


def _shared(keys: DataFrame, parts: int) -> DataFrame:
    """(key, s1, many, least) of the keys that several sets hold: how many, about, and the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "s1", "low", "many", "least"]
        held = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(1, 8)), strict=True):
                key, s1, at, many, other, member, low = (np.frombuffer(x, np.int64) for x in row)
                times = np.ones(len(key), np.int64)
                times[at] = many
                held.append((key, s1, times))
                if len(other):
                    none = pa.array(np.zeros(len(other), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(other), pa.array(member), pa.array(low), none, none], names)
        if not held:
            return
        key, s1, many = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = by_pairs(key, s1)
        key, s1, many = key[order], s1[order], many[order]
        if not len(key):
            return
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        several = (np.maximum.reduceat(many, start) > 1) | (s1[start] != s1[start + size - 1])
        total, least = np.repeat(np.add.reduceat(many, start), size), np.repeat(s1[start], size)
        keep = np.repeat(several, size)
        keep[1:] &= (key[1:] != key[:-1]) | (s1[1:] != s1[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, s1, s1, total, least)], names)

    dealt = keys.repartitionById(parts, F.col("part")).mapInArrow(run, "key long, s1 long, low long, many long, least long")
    dealt = materialize(dealt, "dealt")
    heads = dealt.where("many > 0")
    others = dealt.where("many = 0").select("key", "low", "s1").join(heads.select("key", "low", "many", "least"), ["key", "low"])
    return heads.select("key", "s1", "many", "least").unionByName(others.select("key", "s1", "many", "least"))


# joins of trees

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each task, without the task."""
    task, held = None, []
    for b in batches:
        for t, *row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
            if t != task:
                if len(held) > 1:
                    yield held
                task, held = t, []
            held.append(row)
    if len(held) > 1:
        yield held


def _survivors(tasks: DataFrame, points: DataFrame, num: int, den: int, apart: bool = False) -> DataFrame:
    """tasks: (task, side, rep, label). (near, first, rep): the sets that pairs of different labels under the bound connect, in
    groups: a number that equal groups share, the smallest rep, and each. A pair connects its labels or, apart, its sets only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches):
            side, rep, label, n, points = zip(*held, strict=True)
            ids = np.array(rep, np.int64)
            pairs, joined = connect([np.frombuffer(p, np.uint8) for p in points], np.array(n), np.array(label), np.array(side), num, den, apart=apart)
            if not pairs:
                continue
            at = np.unique(np.array(pairs))  # the rest of a label is in no pair; groups that keep labels whole reach it by the label
            order = at[np.lexsort((ids[at], joined[at]))]
            group, ids = joined[order], ids[order]
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[start, len(ids)])
            with np.errstate(over="ignore"):
                near = np.add.reduceat(mix(ids.view(np.uint64)), start)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(near, size).view(np.int64)), pa.array(np.repeat(ids[start], size)), pa.array(ids)], ["near", "first", "rep"])

    rows = tasks.join(points.select("rep", "n_shingles", "point"), "rep").select("task", "side", "rep", "label", "n_shingles", "point")
    return rows.repartition("task").sortWithinPartitions("task", "rep").mapInArrow(run, "near long, first long, rep long")


def _linked(tasks: DataFrame, docs: DataFrame, points: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """tasks: (task, rep, label). (a, b): a forest of the links between sets of different labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                h, first = sets(b.column(4), shingle)
                cut = [h[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                own = pa.array(_sums(h, first, 0x51) == b.column(3).to_numpy())  # rows that repeat a doc_id may hold other texts
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), pa.array(cut, pa.binary())], ["task", "rep", "label", "set"]).filter(own)

        for held in _runs(rows()):
            rep, label, own = zip(*held, strict=True)
            own = [np.frombuffer(s, np.uint64) for s in own]

            def accept(i: int, j: int, own=own) -> bool:
                both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                return den * both >= num * (len(own[i]) + len(own[j]) - both)

            pairs, _ = connect([point(s) for s in own], np.array([len(s) for s in own]), np.array(label), np.zeros(len(own), np.int64), num, den, accept)
            if pairs:
                a, b = np.array(rep, np.int64)[np.array(pairs)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    wanted = tasks.join(points.select("rep", "s1"), "rep")
    text = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")
    # merged at every size: the list grows with the corpus
    rows = text.join(wanted.hint("merge"), "rep").select("task", "rep", "label", "s1", "text")
    return rows.repartition("task").sortWithinPartitions("task", "rep").mapInArrow(run, "a long, b long")


def _cuts() -> Column:
    return F.ceil(F.greatest(F.col("many") / MOST, F.col("weight") / WEIGHT)).cast("int")


def _gathered(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """members: (key, rep, n_shingles); hubs: (key, rep). (task, side, rep, label): chunks of each key, each with the hub."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("n_shingles").alias("weight")).where("many > 1").select("key", _cuts().alias("cuts"))
    own = members.join(sizes, "key").select("key", "rep", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int").alias("own"))
    hub = hubs.join(sizes, "key").select("key", "rep", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("own"))
    rows = own.unionByName(hub).distinct()
    return rows.select(F.xxhash64("key", "own").alias("task"), F.lit(0).alias("side"), "rep", F.col("rep").alias("label"))


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """shared: (key, rep, n_shingles); labels: (node, component). (task, side, rep, label) of the keys whose sets have several
    labels; of keys with the same sets one. A large key is cut into chunks: those of its main label meet the others' only,
    and these meet one another."""
    placed = shared.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("label"))
    each = F.xxhash64("rep")
    sizes = placed.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("many"), F.sum("n_shingles").alias("weight"),
        F.bit_xor(each).alias("x"), F.sum(F.shiftright(each, 24)).alias("y"), F.min("rep").alias("least"), F.max("rep").alias("most"),
    ).where("low <> high")
    one = sizes.groupBy("x", "y", "least", "most", "many").agg(F.min("key").alias("key"), F.first("weight").alias("weight"))
    rows = placed.join(one.select("key", "many", "weight", _cuts().alias("cuts")), "key")
    rows = materialize(rows.select("key", "rep", "label", "many", "cuts"), "open")
    small = rows.where("cuts = 1").select(F.col("key").alias("task"), F.lit(0).alias("side"), "rep", "label")
    large = rows.where("cuts > 1")
    if not large.limit(1).count():
        return small
    main = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max(F.struct("size", "label")).alias("main"))
    large = large.join(main, "key").withColumn("more", F.ceil(F.col("cuts") * (1 - F.col("main.size") / F.col("many")) + F.lit(0.5)).cast("int"))
    is_main, of = F.col("label") == F.col("main.label"), F.xxhash64("rep")
    large = large.withColumn("own", F.when(is_main, F.pmod(of, F.col("cuts"))).otherwise(F.col("cuts") + F.pmod(of, F.col("more"))).cast("int"))
    first = F.when(is_main, F.col("cuts")).otherwise(F.lit(0))
    large = large.withColumn("other", F.explode(F.sequence(first, F.col("cuts") + F.col("more") - 1)))
    task = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return small.unionByName(large.select(task.alias("task"), F.col("own").alias("side"), "rep", "label"))


def _labels(groups: DataFrame) -> DataFrame:
    """groups: (near, first, rep). (node, component): equal only for what groups connect, whether or not for all of it: chunks of
    a home are one by the hub that they share. No more is needed to see which keys are open."""
    least = groups.groupBy("rep").agg(F.min("first").alias("least"))
    whole = groups.join(least, "rep").groupBy("near").agg(F.min("least").alias("component"))
    return groups.join(whole, "near").groupBy(F.col("rep").alias("node")).agg(F.min("component").alias("component"))


@tidy
def near_duplicates(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """docs: doc_id, text. A row for each input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links of similarity num/den or more, the document itself included).

    Words are runs of non-blanks, A-Z in lower case; a text of fewer words than a shingle is one shingle; null and empty
    texts have none and link with nothing. Rows of one doc_id are one document; a null doc_id has a null component. An
    empty table gives an empty one; other columns of docs are not read.
    """
    spark = docs.sparkSession
    scanned = materialize(_signatures(docs, shingle), "signatures")
    base = scanned.where("n_shingles >= 0")
    same = ["n_shingles", "s1", "s2"]
    some = base.where("n_shingles > 0 and doc_id is not null")
    n = F.col("n_shingles")
    total = int(some.agg(F.sum(n - F.ceil(num * n / den) + 1 + F.floor(n / SPARE))).first()[0] or 0)  # of keys
    reps = materialize(some.groupBy(*same).agg(F.min("doc_id").alias("rep")), "reps", total)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // DEALT + 1)

    every = _shared(_keys(docs, shingle, num, den, _ranks(scanned), parts), parts).join(reps.select("s1", "rep", "n_shingles"), "s1")
    rank = F.dense_rank().over(Window.partitionBy("s1").orderBy(F.col("many").desc(), "key"))
    forget = F.floor(F.ceil(num * n / den) / SPARE)
    shared = every.withColumn("rank", rank).where(F.col("rank") > forget).dropDuplicates(["s1", "key"])
    shared = materialize(shared.select("key", "rep", "n_shingles", "least"), "shared", total)

    # what shares a key, with its point; rows that repeat a doc_id may hold other sets
    live = shared.select("rep").distinct().join(reps, "rep")
    found = some.select(F.col("doc_id").alias("rep"), "s1", "point").join(live, ["rep", "s1"]).select("rep", "s1", "n_shingles", "point")
    points = materialize(found.dropDuplicates(["rep", "s1"]), "points", total)

    # (1) homes
    votes = shared.groupBy("rep", "n_shingles", "least").agg(F.count(F.lit(1)).alias("votes"))
    home = votes.groupBy("rep", "n_shingles").agg(F.max(F.struct("votes", "least"))["least"].alias("key"))
    hubs = home.select("key").distinct().join(points.select(F.col("s1").alias("key"), "rep", "n_shingles"), "key")
    members = materialize(home.select("key", "rep", "n_shingles").unionByName(hubs.select("key", "rep", "n_shingles")).distinct(), "homes", total)
    groups = materialize(_survivors(_gathered(members, hubs.select("key", "rep")), points, num, den), "near")
    edges = groups.select(F.col("first").alias("a"), F.col("rep").alias("b"))
    # (2) keys
    more = materialize(_survivors(_open(shared, _labels(groups)), points, num, den).select("first", "rep").distinct(), "near")
    group = components(edges.unionByName(more.select(F.col("first").alias("a"), F.col("rep").alias("b"))), "groups")
    # (3) texts
    members = materialize(group.join(points, F.col("node") == F.col("rep")).select(F.col("component").alias("key"), "rep", "n_shingles"), "groups", total)
    chunks = _gathered(members, members.select("key", F.col("key").alias("rep")).distinct())
    links = materialize(_linked(chunks.select("task", "rep", "label"), docs, points, shingle, num, den), "links")
    near = components(links, "links")
    # (4) what chunks didn't connect
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("n_shingles").alias("weight")).where(_cuts() > 1)
    if large.limit(1).count():
        rest = shared.join(members.join(large, "key").select("rep"), "rep", "left_semi")
        labels = near.select(F.col("node").alias("rep"), F.col("component").alias("label"))
        left = _survivors(_open(rest, near), points, num, den, True).select(F.col("near").alias("task"), "rep").distinct()
        left = left.join(labels, "rep", "left").select("task", "rep", F.coalesce("label", "rep").alias("label"))
        links = materialize(links.unionByName(_linked(left, docs, points, shingle, num, den)), "links")
        near = components(links, "links")

    twice = some.join(reps, same).select("doc_id", "rep").distinct()
    several = twice.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    twice = twice.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    found = components(links.unionByName(twice), "links") if several.limit(1).count() else near
    out = base.drop("point").join(reps, same, "left").join(found, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def first_of_each(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """docs without near-duplicates: of each component the smallest doc_id stays, once, whichever of its rows comes first; rows
    without a doc_id all stay, and so does every document without words. All columns are returned, whatever their names."""
    found = near_duplicates(docs, shingle, num, den)
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    keep = keep.select(F.col("doc_id").alias("kept"), "rows")
    out = docs.join(keep.hint("merge"), docs["doc_id"] == keep["kept"], "left_semi")
    if keep.where("rows > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.unionAll(docs.where("doc_id is null"))
