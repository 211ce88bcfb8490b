"""Inputs of the registered queries, derived from the driver's tables; the same expressions serve both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SESSION = "'s' || CAST(user_id AS STRING)"
_LABEL = "CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'EXACT_HIT' WHEN event_type = 'view' THEN 'HIT' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'SOFT_HIT' ELSE 'MISS' END"
_RAW = "(100 + CAST(floor(abs(value)) AS BIGINT) * 3 + (event_id % 50) * 20)"
_OPT = f"({_RAW} - CAST(floor({_RAW} * (event_id % 5) / 10.0) AS BIGINT))"
REQUEST_LOG = {
    "request_seq": "event_id",
    "request_id": "'r' || CAST(event_id % 7000 AS STRING)",
    "session_id": _SESSION,
    "provider": "CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END",
    "model": "'m' || CAST(event_id % 2 AS STRING)",
    "cache_hit": f"({_LABEL}) <> 'MISS'",
    "raw_input_tokens": _RAW,
    "optimized_input_tokens": _OPT,
    "upstream_input_tokens": f"CASE WHEN ({_LABEL}) <> 'MISS' THEN 0 ELSE {_OPT} END",
    "output_tokens": "(event_id % 7) * 60",
    "saved_tokens": f"CASE WHEN ({_LABEL}) <> 'MISS' THEN {_RAW} ELSE {_RAW} - {_OPT} END",
    "strategies": "'guard_mode' || CASE WHEN event_id % 3 = 1 THEN ',secret_redaction' ELSE '' END || CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN ',exact_cache' ELSE '' END || CASE WHEN event_id % 4 = 2 THEN ',log_folding' ELSE '' END",
    "failover_used": "event_id % 9 = 0",
    "secrets_redacted": "event_id % 3",
    "pii_redacted": "event_id % 2",
    "guard_mode": "'enabled'",
    "budget_mode": "CASE event_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'saving' WHEN 2 THEN 'critical' ELSE 'normal' END",
    "notes_deduplicated": "CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END",
    "turns_shrunk": "event_id % 5",
    "cache": f"CASE WHEN event_id % 6 = 0 THEN NULL ELSE {_LABEL} END",
    "code_pruned": "CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END",
    "logs_folded": "CASE WHEN event_id % 4 = 2 THEN 5 ELSE 0 END",
    "json_compressed": "CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END",
}
STUDY_EVENTS = {
    "event_seq": "event_id",
    "session_id": _SESSION,
    "request_id": "'r' || CAST(event_id % 7000 AS STRING)",
    "topic": "event_type || ' ' || CAST(event_id % 2 AS STRING)",
    "question": "CASE WHEN event_id % 5 = 0 THEN '[Context: user: hi] Question: why ' || event_type || '?' WHEN event_id % 7 = 0 THEN '' ELSE 'what is ' || event_type || '?' END",
    "answer": "'It is the ' || event_type || '. It counts ' || CAST(event_id AS STRING) || ' times.'",
    "cache_hit": "event_type = 'view'",
}


def sql(columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in REQUEST_LOG.items()))
    longs = [n for n in REQUEST_LOG if n.endswith(("tokens", "redacted", "deduplicated", "shrunk", "pruned", "folded", "compressed"))]
    return log.withColumns({n: F.col(n).cast("long") for n in longs} | {"strategies": F.split("strategies", ",")})


def study_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in STUDY_EVENTS.items()))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
