"""Schemas, readers and writers of the engine's tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column lists in DDL: messages, cache entries, request log, study events, code snapshots.
SCHEMAS = {
    "messages": "request_id string, session_id string, msg_idx int, role string, content string, parts array<struct<type:string,text:string,raw:string>>",
    "cache_entries": "entry_id bigint, question string, question_hash string, answer string, vector array<double>, model string, provider string, hit_count bigint, created_at timestamp",
    "request_log": (
        "request_seq bigint, request_id string, session_id string, provider string, model string, cache_hit boolean, raw_input_tokens bigint, optimized_input_tokens bigint, upstream_input_tokens bigint, "
        "output_tokens bigint, saved_tokens bigint, strategies array<string>, failover_used boolean, secrets_redacted bigint, pii_redacted bigint, guard_mode string, budget_mode string, notes_deduplicated bigint, "
        "turns_shrunk bigint, cache string, provider_attempts array<struct<provider:string,status:int>>, code_pruned bigint, logs_folded bigint, json_compressed bigint, comments_stripped bigint, phrases_compacted bigint, created_at timestamp"
    ),
    "study_events": "event_seq bigint, session_id string, request_id string, topic string, question string, answer string, cache_hit boolean, cache_type string, created_at timestamp",
    "code_snapshots": "snapshot_seq bigint, session_id string, file_key string, code string, created_at timestamp",
}
#: Columns that other tables than the first version have, with what older rows get.
DEFAULTS = {"guard_mode": "enabled", "budget_mode": "saving", "cache": "MISS", "hit_count": 0, "comments_stripped": 0, "phrases_compacted": 0, "code_pruned": 0, "logs_folded": 0, "json_compressed": 0}
#: What each table is laid out by; lookups go by these columns.
LAYOUT = {"messages": "session_id", "request_log": "session_id", "study_events": "session_id", "code_snapshots": "session_id", "cache_entries": None}


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of a table: what it lacks is filled with the default, else null; what it has too many goes."""
    fields = T.StructType.fromDDL(SCHEMAS[name]).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in fields))


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of any earlier version."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path), name)


def append(df: DataFrame, path: str, name: str) -> None:
    conform(df, name).write.mode("append").parquet(path)


def insert(df: DataFrame, path: str, name: str, key: str) -> DataFrame:
    """Appends rows under new ids and gives them back with these. Ids are above all that the table has and grow with the
    rows' partitions; they aren't dense, so that no task has to see all rows. One writer at a time."""
    spark = df.sparkSession
    try:
        known = read_table(spark, path, name)
    except AnalysisException:  # there is no table yet
        known = None
    top = (known.agg(F.max(key)).first()[0] if known is not None else None) or 0
    append(df.withColumn(key, F.monotonically_increasing_id() + F.lit(top + 1)), path, name)
    return read_table(spark, path, name).where(F.col(key) > top)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests in JSON lines {request_id, session_id?, stream?, messages: [{role, content}]}: streaming ones and those of
    more than 50 messages are left out. Content may be text or a list of parts."""
    raw = spark.read.schema("request_id string, session_id string, stream boolean, messages array<struct<role:string,content:variant>>").json(path)
    ok = raw.where(~F.coalesce("stream", F.lit(False)) & (F.size("messages") <= 50))
    rows = ok.select("request_id", F.coalesce("session_id", F.lit("default")).alias("session_id"), F.posexplode("messages").alias("msg_idx", "m"))
    kind = F.schema_of_variant("m.content")
    parts = F.expr("try_variant_get(m.content, '$', 'array<struct<type:string,text:string>>')")
    parts = F.transform(parts, lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.lit(None).cast("string").alias("raw")))
    text = F.when(kind == "STRING", F.expr("try_variant_get(m.content, '$', 'string')"))
    return rows.select("request_id", "session_id", "msg_idx", "m.role", text.alias("content"), F.when(kind.startswith("ARRAY"), parts).alias("parts"))


@dataclass(frozen=True)
class Provider:
    """One that may be named without a key: it isn't configured then."""

    name: str
    base_url: str
    api_key: str
    model: str

    @property
    def configured(self) -> bool:
        return bool(self.api_key)


# The chain where none is set up, in order: name, base URL, model, whether it is always part of it.
CHAIN = [
    ("google", "https://generativelanguage.googleapis.com/v1beta/openai", "gemini-3.5-flash", True),
    ("vercel", "https://ai-gateway.vercel.sh/v1", "openai/gpt-5.5", True),
    ("ollama", "https://ollama.com/v1", "gpt-oss:20b", False),
    ("kilo", "https://api.kilo.ai/api/gateway", "openrouter/free", False),
    ("groq", "https://api.groq.com/openai/v1", "llama-3.1-8b-instant", True),
]


def default_providers(options: dict[str, str]) -> list[Provider]:
    """The chain, with <name>_base_url, <name>_api_key and <name>_model from the options; some only if one of the first two is
    set."""
    own = lambda name, what, default="": options.get(f"{name}_{what}") or default
    part = [row for row in CHAIN if row[3] or own(row[0], "api_key") or own(row[0], "base_url")]
    return [Provider(name, own(name, "base_url", url), own(name, "api_key"), own(name, "model", model)) for name, url, model, _ in part]


@dataclass(frozen=True)
class EngineConfig:
    """Settings, from plain options (a Spark conf, an environment or a dotenv file). cache.resolve() takes the thresholds and
    whether soft hits are verified, pipeline.optimise() the default mode and the turns that are kept word for word."""

    hard_threshold: float = 0.95
    soft_threshold: float = 0.90
    default_budget: str = "normal"
    verify_soft_hits: bool = True
    verbatim_turns: int = 2
    embedding_backend: str = "hash"
    providers: tuple[Provider, ...] = field(default=())

    @classmethod
    def of(cls, options: dict[str, str]) -> EngineConfig:
        single = options.get("threshold")
        hard = float(options.get("hard_threshold") or single or 0.95)
        soft = float(options.get("soft_threshold") or 0.90)
        kept = options.get("verbatim_turns", "2")
        return cls(
            hard, min(hard, soft) if single and not options.get("hard_threshold") else soft, options.get("default_budget", "normal").lower(),
            options.get("verify_soft_hits", "true").strip().lower() not in ("0", "false", "no", "off"), max(0, int(kept)) if kept.lstrip("-").isdigit() else 2,
            options.get("embedding_backend", "hash"), tuple(providers(options) or default_providers(options)),
        )

    @classmethod
    def from_session(cls, spark: SparkSession, prefix: str = "spark.loomspan.") -> EngineConfig:
        """Options from the session's settings of that prefix."""
        return cls.of({k.removeprefix(prefix): v for k, v in spark.conf.getAll.items() if k.startswith(prefix)})


def provider_status(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """name, configured, model of the providers, in order of position."""
    rows = [(k, p.name, p.configured, p.model) for k, p in enumerate(config.providers)]
    return spark.createDataFrame(rows, "position int, name string, configured boolean, model string")


def health(spark: SparkSession, config: EngineConfig, dimension: int = 384) -> DataFrame:
    """One row: ok, embedding_backend, embedding_dimension and the providers."""
    rows = [(True, config.embedding_backend, dimension, [(p.name, p.configured, p.model) for p in config.providers])]
    return spark.createDataFrame(rows, "ok boolean, embedding_backend string, embedding_dimension int, providers array<struct<name:string,configured:boolean,model:string>>")


def providers(options: dict[str, str]) -> list[Provider]:
    """Providers 1 to 20 in order; one that lacks a setting is an error that names what is missing."""
    out = []
    for k in range(1, 21):
        got = {f: options.get(f"provider_{k}_{f}", "") for f in ("name", "base_url", "api_key", "model")}
        if any(got.values()):
            if missing := [f"provider_{k}_{f}" for f, v in got.items() if not v]:
                raise ValueError(f"incomplete provider: {', '.join(missing)}")
            out.append(Provider(**got))
    return out


def dotenv(text: str, known: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines of a dotenv file, comments aside; what is known already stays."""
    out = dict(known)
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and not key.startswith("#"):
            out.setdefault(key.strip(), value.strip().strip("\"'"))
    return out
