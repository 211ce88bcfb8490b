"""Near-duplicate vectors by NN-descent.

Equal vectors of a label take part once. A first graph of K neighbours comes from blocks of nearby vectors: cells of
random hyperplanes, several times over, each cell compared with itself; a cell that is too full is cut by more hyperplanes,
and what these can't tell apart by a hash. The graph is then refined: the neighbours of a vector, forward and backward, are
compared with one another, and every list keeps its best; a neighbourhood that is too large is cut by another hash in every
round. Rounds go on until no link above the threshold joins two components. Whatever is compared in one place gives, besides
the best K of each vector, all its links above the threshold as a spanning forest. A list whose K neighbours are all links
grows by the best K of other components; a link among these joins the two and makes room, so that no list stays full of links.
An audit compares samples of the vectors without a link, of those in small and of those in large components with all others,
larger samples until they show enough links; while the recall is below the one asked for more cells are added, and where it
stays below the least that is allowed the query fails.
Links are counted exactly inside each component without making rows of pairs: vectors within half the threshold's angle of
the component's first one are linked with one another for certain and are only counted, the others are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm.common import components, materialize, tidy

#: Neighbours in a list; vectors of a block; cells' tables of a turn; the recall that ends the turns, their number, and the
#: recall below which their result is an error.
K, BLOCK, TABLES, RECALL, TURNS, LEAST = 10, 1024, 4, 0.99, 8, 0.9
#: The audit's sample of each kind of vector, at first and at most; links that it has to see.
AUDIT, AUDIT_MOST, AUDIT_LINKS = 512, 8192, 200
#: Hyperplanes of a table.
PLANES = 40
_SEED = 3
_PAIRS = "u long, v long, sim double"


def _unit(column: pa.Array) -> np.ndarray:
    """Rows scaled to length one, in double precision. All have the same length and a component that isn't zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Runs of rows with one key, which stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(int(a), int(b - a))
            if held and held[-1].column(key)[0].as_py() != int(keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row reachable."""
    labels = np.arange(len(linked))
    while True:
        least = np.where(linked, labels[None, :], len(labels)).min(1)
        least = np.minimum(least, labels)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def _best_of(sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and similarity of the best n of each row."""
    top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    i, j = np.repeat(np.arange(len(sims)), n), top.ravel()
    return i, j, sims[i, j]


def _compare(ids: np.ndarray, rows: np.ndarray, component: np.ndarray, worst: np.ndarray, far: np.ndarray, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row that beat its list's worst, for rows whose list is full of links the best k of other
    components too that beat the worst of those, and a spanning forest of the links."""
    sims = rows @ rows.T
    np.fill_diagonal(sims, -2)
    m = len(ids)
    n = min(k, m - 1)
    if n < 1:
        return ids[:0], ids[:0], np.empty(0)
    i, j, s = _best_of(sims, n)
    least = s.reshape(m, n).min(1) if n == k else np.full(m, -2.0)
    full = np.flatnonzero(np.maximum(least, worst) >= threshold)
    good = s > worst[i]
    i, j, s = i[good], j[good], s[good]
    linked = sims >= threshold
    touched = np.flatnonzero(linked.any(1))
    if len(touched):
        root = np.arange(m)
        root[touched] = touched[_forest(linked[np.ix_(touched, touched)])]
        for a in range(0, len(full), BLOCK):
            at = full[a : a + BLOCK]
            away = (component[at][:, None] != component[None]) & (root[at][:, None] != root[None])
            x, y, z = _best_of(np.where(away, sims[at], -2), n)
            good = z > far[at][x]
            i, j, s = np.r_[i, at[x[good]]], np.r_[j, y[good]], np.r_[s, z[good]]
        a, b = touched[root[touched] != touched], root[touched][root[touched] != touched]
        # a vector and its root may be linked through others only; their own similarity says nothing then
        i, j, s = np.r_[i, a], np.r_[j, b], np.r_[s, np.full(len(a), np.inf)]
    return ids[i], ids[j], s


def _pairs(groups: DataFrame, threshold: float, k: int) -> DataFrame:
    """groups: (group, uid, vector, component, worst, far), a group's rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            ids = g.column("uid").to_numpy()
            ids, at = np.unique(ids, return_index=True)
            rows = _unit(g.column("vector").combine_chunks())[at]
            component, worst, far = (g.column(c).to_numpy()[at] for c in ("component", "worst", "far"))
            u, v, s = _compare(ids, rows, component, worst, far, threshold, k)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], ["u", "v", "sim"])

    return groups.mapInArrow(run, _PAIRS)


def _placed(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows with the component of each uid; a vector without links is its own."""
    if found is None:
        return rows.withColumn("component", F.col("uid"))
    return rows.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))


def _cells(reps: DataFrame, found: DataFrame | None, tables: range, threshold: float, k: int) -> DataFrame:
    """Best neighbours in the cells of random hyperplanes, for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(2)
            sizes = np.diff(rows.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == dim))
                unit = _unit(rows.take(at))
                for t in tables:
                    planes = np.random.default_rng([_SEED, t, int(dim)]).normal(size=(PLANES, int(dim)))
                    code = ((unit @ planes.T > 0) * (1 << np.arange(PLANES))).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t)), b.column(0).take(at), pa.array(code), b.column(1).take(at)], ["t", "space", "code", "uid"])

    codes = materialize(reps.select("space", "uid", "vector").mapInArrow(run, "t long, space long, code long, uid long"), "codes")
    planes = lambda many: F.greatest(F.ceil(F.log2(F.col(many) / BLOCK)), F.lit(0))
    cell = lambda bits: F.pmod(F.col("code"), F.pow(F.lit(2.0), bits).cast("long"))
    per = reps.groupBy("space").agg(F.count(F.lit(1)).alias("many")).select("space", planes("many").alias("bits"))
    codes = codes.join(per, "space").withColumn("cell", cell(F.col("bits")))
    full = codes.groupBy("t", "space", "cell").agg(F.count(F.lit(1)).alias("full"))
    more = F.when(F.col("full") > 2 * BLOCK, planes("full")).otherwise(0)
    codes = codes.join(full, ["t", "space", "cell"]).withColumn("group", F.xxhash64("t", "space", "cell", cell(F.least(F.col("bits") + more, F.lit(PLANES))))).select("t", "group", "uid")
    codes = materialize(codes, "cells")
    full = codes.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("cuts"))
    codes = codes.join(full, "group").select(F.xxhash64("group", F.pmod(F.xxhash64("uid", "t"), F.col("cuts"))).alias("group"), "uid")
    groups = codes.join(_placed(reps.select("uid", "vector"), found), "uid")
    groups = groups.select("group", "uid", "vector", "component", F.lit(-2.0).alias("worst"), F.lit(-2.0).alias("far"))
    return _pairs(groups.repartition("group").sortWithinPartitions("group"), threshold, k)


def _best(pairs: DataFrame, found: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k best of each list, and the k best of other components (far) for a list that is full of links: (u, v, sim, far).
    Links from forests, whose similarity is infinite, are no neighbours."""
    once = pairs.where("sim <= 1.5").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    rank = once.withColumn("rank", F.row_number().over(order))
    rank = rank.withColumn("last", F.max(F.when(F.col("rank") == k, F.col("sim"))).over(Window.partitionBy("u")))
    rank = materialize(rank.where((F.col("rank") <= k) | (F.col("last") >= threshold)), "ranked")
    # the first k of a full list are all in its own component
    more = rank.where(F.col("rank") > k).select("u", "v", "sim")
    for end in ("u", "v"):
        more = more.join(found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    more = more.where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).withColumn("rank", F.row_number().over(order))
    near = rank.where(F.col("rank") <= k).select("u", "v", "sim", F.lit(False).alias("far"))
    return near.unionAll(more.where(F.col("rank") <= k).select("u", "v", "sim", F.lit(True).alias("far")))


def _refine(graph: DataFrame, found: DataFrame, reps: DataFrame, threshold: float, k: int, turn: int = 0) -> DataFrame:
    """Compares the neighbours of each vector with one another. turn: another one cuts large neighbourhoods otherwise."""
    def least(kind: Column) -> Column:
        return F.when(F.count_if(kind) >= k, F.min(F.when(kind, F.col("sim")))).otherwise(F.lit(-2.0))

    worst = graph.groupBy("u").agg(least(~F.col("far")).alias("worst"), least(F.col("far")).alias("far"))
    both = graph.select(F.col("u").alias("c"), F.col("v").alias("uid")).unionAll(graph.select(F.col("v").alias("c"), F.col("u").alias("uid")))
    both = both.unionAll(worst.select(F.col("u").alias("c"), F.col("u").alias("uid"))).distinct()
    many = both.groupBy("c").agg(F.count(F.lit(1)).alias("many"))
    both = both.join(many, "c").withColumn("cut", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.ceil(F.col("many") / BLOCK)))
    known = _placed(reps.select("uid", "vector"), found).join(worst.withColumnRenamed("u", "uid"), "uid", "left")
    none = F.lit(-2.0)
    known = known.select("uid", "vector", "component", F.coalesce("worst", none).alias("worst"), F.coalesce("far", none).alias("far"))
    groups = both.join(known, "uid").select(F.xxhash64("c", "cut").alias("group"), "uid", "vector", "component", "worst", "far")
    return _pairs(groups.repartition("group").sortWithinPartitions("group"), threshold, k)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, uid, copies, vector, first) -> (component, uid, copies, vector, cosine with first)."""
    for b in batches:
        if b.num_rows:
            sizes = np.diff(b.column(3).offsets.to_numpy())
            cosine = np.empty(b.num_rows)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                cosine[at] = (_unit(b.column(3).take(pa.array(at))) * _unit(b.column(4).take(pa.array(at)))).sum(1)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(cosine)], ["component", "uid", "copies", "vector", "cosine"])


def _count(reps: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(uid, links): for each vector of a component the rows of the other vectors that it is linked with."""
    inside = reps.join(found, F.col("uid") == F.col("node")).select("component", "uid", "copies", "vector")
    many = inside.groupBy("component").agg(F.count(F.lit(1)).alias("many"), F.min("uid").alias("hub"))
    small = inside.join(many.where(F.col("many") <= 2 * BLOCK), "component")
    tasks = small.select(F.xxhash64("component").alias("group"), F.lit(0).alias("side"), "uid", "copies", "vector")
    large = many.where(F.col("many") > 2 * BLOCK)
    core = None
    if large.limit(1).count():
        # what lies within half the angle of the hub is linked with all that does
        hubs = large.join(reps.select(F.col("uid").alias("hub"), F.col("vector").alias("first")), "hub")
        near = inside.join(hubs.select("component", "first"), "component").select("component", "uid", "copies", "vector", "first")
        near = materialize(near.mapInArrow(_cosines, "component long, uid long, copies long, vector array<double>, cosine double"), "angles")
        near = near.withColumn("core", F.col("cosine") >= float(np.cos(np.arccos(threshold) / 2 - 1e-7)))
        sizes = near.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("sure"), F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("others"))
        near = near.join(sizes, "component")
        core = near.where("core").select("uid", (F.col("sure") - F.col("copies")).alias("links"))
        cuts = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
        of = F.xxhash64("uid")
        near = near.where("others > 0").withColumn("own", F.when(F.col("core"), F.pmod(of, cuts("cores"))).otherwise(cuts("cores") + F.pmod(of, cuts("others"))).cast("int"))
        near = near.withColumn("other", F.explode(F.sequence(F.when(F.col("core"), cuts("cores")).otherwise(F.lit(0)), cuts("cores") + cuts("others") - 1)))
        task = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
        tasks = tasks.unionByName(near.select(task.alias("group"), F.col("own").alias("side"), "uid", "copies", "vector"))
    tasks = tasks.repartition("group").sortWithinPartitions("group", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            side, ids, copies = (g.column(c).to_numpy() for c in ("side", "uid", "copies"))
            rows = _unit(g.column("vector").combine_chunks())
            sides = np.unique(side)
            if len(sides) == 1:
                links = np.zeros(len(ids), np.int64)
                for a in range(0, len(ids), BLOCK):
                    linked = rows[a : a + BLOCK] @ rows.T >= threshold
                    linked[np.arange(len(linked)), np.arange(a, a + len(linked))] = False
                    links[a : a + BLOCK] = linked @ copies
            else:
                links = np.zeros(len(ids), np.int64)
                x, y = (np.flatnonzero(side == s) for s in sides)
                for a in range(0, len(x), BLOCK):
                    linked = rows[x[a : a + BLOCK]] @ rows[y].T >= threshold
                    links[x[a : a + BLOCK]] += linked @ copies[y]
                    links[y] += linked.T @ copies[x[a : a + BLOCK]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["uid", "links"])

    links = tasks.mapInArrow(run, "uid long, links long")
    links = links.unionByName(core) if core is not None else links
    return links.groupBy("uid").agg(F.sum("links").alias("links"))


def _links(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))


def _merge(found: DataFrame | None, links: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """found, (node, component), with the links (a, b); and how many pairs of components they join that were apart."""
    if found is not None:
        for end in ("a", "b"):
            of = found.select(F.col("node").alias(end), F.col("component").alias("of"))
            links = links.join(of, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    apart = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "apart")
    many = apart.count()
    if found is not None and not many:
        return found, 0
    over = components(apart, "near")
    if found is not None:
        top = over.select(F.col("node").alias("component"), F.col("component").alias("top"))
        moved = found.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        over = moved.unionAll(over.join(found.select("node"), "node", "left_anti"))
    return materialize(over, "near", rows), many


def audit(reps: DataFrame, found: DataFrame, threshold: float, k: int = K) -> float:
    """Recall: the share inside components of a vector's links with all others, on average over the vectors that have links.
    Vectors without a link, in components of up to k, and in larger ones are sampled apart and count by their numbers; the
    large ones by themselves too, and the lower average is the result. Samples grow until they show AUDIT_LINKS links, hold
    all vectors or AUDIT_MOST of each kind. 1 if no vector is linked with another; without any link seen that is what is known.
    """
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = reps.join(found.join(sizes, "component"), F.col("uid") == F.col("node"), "left")
    size = F.coalesce("size", F.lit(1))
    kind = F.when(size == 1, 0).when(size <= k, 1).otherwise(2)
    placed = materialize(placed.select("space", "uid", F.coalesce("component", "uid").alias("component"), "vector", kind.alias("kind")), "placed")
    totals = {r.kind: r["count"] for r in placed.groupBy("kind").count().collect()}
    sample = AUDIT
    while True:
        seen = _asked(placed, totals, sample, threshold)
        if sum(n for n, *_ in seen.values()) >= AUDIT_LINKS or sample >= min(AUDIT_MOST, max(totals.values(), default=0)):
            break
        sample *= 4
    # of each kind: how many vectors have links, by the sample, and the sum of their recalls
    part = {kind: (totals[kind] * linked / max(1, drawn), totals[kind] * hits / max(1, drawn)) for kind, (_, drawn, linked, hits) in seen.items()}
    every = [(sum(part[x][0] for x in kinds if x in part), sum(part[x][1] for x in kinds if x in part)) for kinds in ((0, 1), (2,))]
    return min((hits / linked for linked, hits in every if linked), default=1.0)


def _asked(placed: DataFrame, totals: dict[int, int], sample: int, threshold: float) -> dict[int, tuple[int, int, int, float]]:
    """For each kind of vector: links seen, vectors drawn, those with links, and the sum of these' recalls."""
    share = {kind: int(min(1.0, sample / max(1, n)) * 1_000_003) + 1 for kind, n in totals.items()}
    below = F.lit(0)
    for kind, n in share.items():
        below = F.when(F.col("kind") == kind, n).otherwise(below)
    asked = placed.where(F.pmod(F.xxhash64(F.lit(_SEED), "uid"), F.lit(1_000_003)) < below).toArrow()
    spaces, kinds = asked.column("space").to_numpy(), asked.column("kind").to_numpy()
    queries = {}
    for x in np.unique(spaces):
        own = asked.filter(pa.array(spaces == x))
        queries[int(x)] = (*(own.column(c).to_numpy(zero_copy_only=False) for c in ("component", "uid", "kind")), _unit(own.column("vector").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {x: np.zeros((2, len(q[1])), np.int64) for x, q in queries.items()}
        for b in batches:
            space, uid, component = (b.column(c).to_numpy() for c in range(3))
            for x in np.unique(space):
                if int(x) in queries:
                    c, q, _, rows = queries[int(x)]
                    every = np.flatnonzero(space == x)
                    for low in range(0, len(every), BLOCK):
                        at = every[low : low + BLOCK]
                        linked = (rows @ _unit(b.column(3).take(pa.array(at))).T >= threshold) & (q[:, None] != uid[at][None])
                        sums[int(x)] += (linked & (c[:, None] == component[at][None])).sum(1), linked.sum(1)
        for x, (hits, links) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(queries[x][1]), pa.array(queries[x][2]), pa.array(hits), pa.array(links)], ["uid", "kind", "hits", "links"])

    each = placed.select("space", "uid", "component", "vector").mapInArrow(run, "uid long, kind int, hits long, links long")
    each = each.groupBy("kind", "uid").agg(F.sum("hits").alias("hits"), F.sum("links").alias("links")).where("links > 0")
    rows = {r.kind: r for r in each.groupBy("kind").agg(F.sum("links").alias("links"), F.count(F.lit(1)).alias("linked"), F.sum(F.col("hits") / F.col("links")).alias("hits")).collect()}
    return {kind: (rows[kind].links, int((kinds == kind).sum()), rows[kind].linked, rows[kind].hits) if kind in rows else (0, int((kinds == kind).sum()), 0, 0.0) for kind in totals}


def _numbered(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """reps with first, their smallest vec_id, and uid, a number for each: first, or below zero for what other vectors
    stand under the same vec_id; and then the pairs that a vec_id links."""
    reps = reps.withColumn("first", F.col("uid"))
    if not reps.groupBy("uid").count().where("count > 1").limit(1).count():
        return reps, None
    rank = F.row_number().over(Window.partitionBy("first").orderBy("space", "vector"))
    other = -1 - F.shiftrightunsigned(F.xxhash64("space", "vector"), 1)
    reps = materialize(reps.withColumn("uid", F.when(rank == 1, F.col("first")).otherwise(other)), "reps")
    return reps, reps.where("uid <> first").select(F.col("first").alias("a"), F.col("uid").alias("b"))


def _renamed(found: DataFrame, reps: DataFrame) -> DataFrame:
    """Components by their smallest vec_id."""
    least = found.join(reps, F.col("node") == F.col("uid")).groupBy("component").agg(F.min("first").alias("least"))
    return materialize(found.join(least, "component").select("node", F.col("least").alias("component")), "near")


@tidy
def near_duplicates(vectors: DataFrame, threshold: float = 0.98, k: int = K) -> DataFrame:
    """vectors: vec_id, embedding, label. A row for each input row: vec_id, n_links (rows of other vectors of the label
    with a cosine of `threshold` or more), component_id (the smallest vec_id reachable by links, itself included), kept
    (whether it is that one), label.

    Vectors that are null, all zero, or hold a null or a component that isn't finite link with nothing; so do those
    without a label or vec_id, and vectors of different lengths. A row that repeats entirely is one vector; vectors under
    one vec_id are in one component. A vec_id below zero is a number like any other as long as vec_ids are unique.
    """
    v = F.col("embedding").cast("array<double>")
    base = vectors.select("vec_id", "label", v.alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd & F.exists("vector", lambda x: x != 0)
    base = materialize(base.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("space", F.xxhash64("label", F.size("vector"))), "vectors")
    some = base.where("usable").select("vec_id", "space", "vector").distinct()
    reps = materialize(some.groupBy("space", "vector").agg(F.min("vec_id").alias("uid"), F.count(F.lit(1)).alias("copies")), "reps")
    reps, shared = _numbered(reps)
    many = reps.count()
    graph = found = None
    for turn in range(TURNS):
        cells = _cells(reps, found, range(turn * TABLES, (turn + 1) * TABLES), threshold, k)
        new = materialize(cells if graph is None else cells.unionAll(new), "cells")
        found, joined = _merge(found, _links(new, threshold), many)[0], 1
        rounds = 0
        while joined:
            graph = materialize(_best(new if graph is None else new.unionAll(graph.drop("far")), found, threshold, k), "graph")
            new = materialize(_refine(graph, found, reps, threshold, k, rounds := rounds + 1), "refined")
            found, joined = _merge(found, _links(new, threshold), many)
        recall = audit(reps, found, threshold, k)
        if recall >= RECALL:
            break
    if recall < LEAST:
        raise RuntimeError(f"op3: recall of links is {recall:.4f} after {TURNS} turns of cells and refinement, below {LEAST}")
    if shared is not None:
        found = _renamed(_merge(found, shared, many)[0], reps)
    counts = materialize(_count(reps, found, threshold), "counts")
    placed = reps.join(found, F.col("uid") == F.col("node"), "left").join(counts, "uid", "left")
    placed = placed.select("space", "vector", F.coalesce("component", "first").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = base.join(placed.withColumn("usable", F.lit(True)), ["usable", "space", "vector"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "label")
