"""Extensions of the batch operators to streams; the engine's other parts don't need them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.conversation import NOTE

_STATE = "hashes array<string>, hints array<string>"


def windowed_metrics(log: DataFrame, time: str = "created_at", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, hits and saved tokens of each time window and budget mode; rows later than `late` are dropped."""
    grouped = log.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "budget_mode")
    sums = grouped.agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("cache_hit").cast("int")).alias("cache_hits"), F.sum("saved_tokens").alias("saved_tokens"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "budget_mode", "requests", "cache_hits", "saved_tokens")


def first_seen(messages: DataFrame, time: str, hash_column: str, late: str = "1 day") -> DataFrame:
    """The first message of each hash, within the time that late rows are waited for: an exact cache's misses."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([hash_column])


def dedup_notes(messages: DataFrame, session: str = "session_id", order: str = "request_seq", content: str = "content", idle: str = "1 hour") -> DataFrame:
    """The batch operator on a stream: a session's known paragraphs are its state, which goes after `idle` without rows.
    Within a batch a session's rows are taken in order."""
    fields = messages.select(session, order, content).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", notes_deduplicated long"
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        frame = pd.concat(frames).sort_values(order)
        texts, counts = [], []
        for body in frame[content]:
            n = 0
            for part in pd.Series(body or "").str.split(r"\n\s*\n", regex=True)[0]:
                if len(part.strip()) < NOTE:
                    continue
                plain = " ".join(part.split())
                h = sha256(plain.encode()).hexdigest()[:8]
                if h in known:
                    body, n = body.replace(part, f'[Reference: note_{h} | Context: "{known[h]}..."]'), n + 1
                else:
                    known[h] = plain[:100]
            texts.append(body)
            counts.append(n)
        state.update((list(known), list(known.values())))
        state.setTimeoutDuration(wait)
        yield frame.assign(**{content: texts, "notes_deduplicated": counts})[[f.name for f in fields] + ["notes_deduplicated"]]

    rows = messages.select(session, order, content).groupBy(session)
    return rows.applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
