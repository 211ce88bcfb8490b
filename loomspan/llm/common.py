"""Shared helpers: tables that cut lineage, fold rules, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: One word: a run of bytes that are neither a blank nor one of TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of the tables that the running operator has written; outside of one none are noted.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master gets a temporary
    folder; on a cluster, whose executors couldn't see it, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: this operator needs a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one. Inside an operator it goes when the operator ends."""
    path = f"{shared_dir(spark)}/loomspan/{tag}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    return path


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again. Cuts the lineage, survives lost executors. rows: a bound on
    their number; where it is small, so is the number of files, 8 or one for each 2**18 rows."""
    path = shared_path(df.sparkSession, tag)
    (df if rows is None else df.coalesce(max(8, rows >> 18))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(paths: list[str]) -> None:
    context = SparkSession.active().sparkContext
    for p in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are removed at the end, whether it ends well or not."""
    outer, mine = _written.get(), []
    _written.set(mine)
    try:
        yield
    finally:
        _written.set(outer)
        _remove(mine)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator's result is written, and the tables that it wrote on the way are removed."""

    @wraps(operator)
    def run(*args, **options) -> DataFrame:
        outer = _written.get()
        with scratch():
            out, mine = operator(*args, **options), _written.get()
            _written.set(outer)
            try:
                return materialize(out, operator.__name__)
            finally:
                _written.set(mine)

    return run


def fresh(name: str, columns: list[str]) -> str:
    """name, or a longer one that no column has."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, mod parts; a null key falls into fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % F.lit(parts), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _stated(edges: DataFrame, tag: str, most: int) -> tuple[DataFrame, tuple]:
    """edges, `most` of them at most, written, and their number and a sum of their hashes, which the writing job sees."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")), F.lit(0)).alias("h")
    out = materialize(edges.observe(seen, *sums), tag, most)
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: two long columns a, b (either order, repeats and loops allowed, nulls are skipped).
    Returns (node, component) for every node that has an edge to another one; component is the smallest node
    reachable. Each step is two aggregations that combine before the shuffle and one join on the node, so a hub
    with very many neighbours is a skewed join that adaptive execution splits, never one task's group.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e, state = _stated(e, tag, edges.count())
    while state[0]:
        sym = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = (
            joined.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .unionAll(joined.select(F.col("m").alias("lo"), "hi"))
            .distinct()
        )
        e, now = _stated(small, tag, 2 * state[0])
        if now == state:
            break
        state = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
