"""Study topics: what a question is about, and which of the session's topics it belongs to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.core import collapse, strip

# Words that are no topic, and how questions begin.
STOP_WORDS = (
    "a an the in on at to for of with by from is are was were be been being have has had do does did can could will would should may might "
    "i you he she it we they my your his her what why how when where which who whom explain describe define tell give show help me about "
    "example please difference between versus vs algorithm concept python javascript java c++ code function again "
    "work works working mean means meaning occur occurs happen happens use used"
).split()
PREFIXES = [
    r"^(?:can\s+you\s+)?(?:please\s+)?(?:explain|describe|define|tell\s+me\s+about)\s+(?:the\s+)?(?:concept\s+of\s+)?",
    r"^(?:what\s+is|what\s+are|why\s+is|why\s+does|how\s+does|how\s+do|how\s+to)\s+(?:the\s+)?",
    r"^(?:give\s+me\s+an?\s+example\s+of)\s+(?:the\s+)?",
]


def clean_question(question: Column) -> Column:
    """Lower case, without context, opening and punctuation but hyphens."""
    q = F.regexp_replace(question, r"\A[\s\S]*?Question:", "")
    q = strip(F.lower(q))
    for p in PREFIXES:
        q = strip(F.regexp_replace(q, f"(?iU){p}", ""))
    return collapse(F.regexp_replace(q, r"(?U)[^\w\s-]", " "))


def new_topic(clean: Column) -> Column:
    """The first three words that aren't stop words, or the first two of any."""
    words = F.split(clean, " ")
    own = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1))
    return F.when(clean == "", "general").when(F.size(own) > 0, F.array_join(F.slice(own, 1, 3), " ")).otherwise(F.array_join(F.slice(words, 1, 2), " "))


def _known(clean: str, topics: dict[str, frozenset[str]]) -> str | None:
    """The first known topic that contains the question or is contained in it, by text or by all its own words."""
    words = frozenset(clean.split(" "))
    return next((t for t, own in topics.items() if t in clean or clean in t or own and own <= words), None)


def extract_topics(events: DataFrame, session: str, order: str, question: str) -> DataFrame:
    """events with their topic. A session's questions stream through one worker in order; what is held is the topics that it
    has so far, so that a long session costs its questions times its topics. Empty questions are about "general"."""
    rows = events.select(F.col(session).alias("s"), F.col(order).alias("at"), clean_question(F.coalesce(question, F.lit(""))).alias("q"))
    rows = rows.withColumn("new", new_topic(F.col("q"))).repartition("s").sortWithinPartitions("s", "at", "q")
    schema = T.StructType([T.StructField(session, rows.schema["s"].dataType), T.StructField(order, rows.schema["at"].dataType), T.StructField("topic", T.StringType())])
    stop = frozenset(STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, topics = object(), {}
        for b in batches:
            out = []
            for s, q, new in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if s != now:
                    now, topics = s, {}
                found = new if not q else _known(q, topics) or new
                topics.setdefault(found.lower().strip(), frozenset(found.lower().strip().split(" ")) - stop)
                out.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], [session, order, "topic"])

    return rows.mapInArrow(run, schema)
