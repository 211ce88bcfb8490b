"""The request pipeline: guard, rewrite chain, no-inflation guard, strategies and receipts, for all requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import comments, pyops, text
from loomspan.functions import scalars as sc
from loomspan.operators import analytics, cache, conversation
from loomspan.sources.tables import EngineConfig

#: (count column, strategy, roles or None, operator) of the per-message steps before and after the session steps.
BEFORE = [
    ("sentences_deduplicated", "sentence_deduplication", "user", text.dedup_sentences),
    ("preambles_stripped", "preamble_stripping", "user", text.strip_preamble),
]
AFTER = [
    ("logs_folded", "log_folding", None, pyops.fold_logs_column),
    ("json_compressed", "json_compression", None, pyops.compress_json_column),
    ("comments_stripped", "comment_stripping", None, comments.strip_comments_column),
    ("binary_replaced", "binary_data_detection", None, text.describe_binary),
    ("phrases_compacted", "phrase_compaction", None, text.compact_phrases),
    ("normalizations", "structural_normalization", None, text.normalize_structure),
]
SESSION = [("notes_deduplicated", "note_deduplication"), ("code_pruned", "code_pruning")]
HISTORY = [("history_filtered", "history_filtering"), ("responses_summarized", "response_summarization")]
KEYS = ["request_seq", "request_id", "session_id", "budget_mode"]


def _apply(df: DataFrame, name: str, role: str | None, op) -> DataFrame:
    """One per-message step; null content and other roles pass."""
    on = F.col("content").isNotNull() if role is None else F.col("content").isNotNull() & (F.col("role") == role)
    df = df.withColumn("_o", F.when(on, op(F.col("content"))))
    return df.withColumns({"content": F.when(on, F.col("_o.text")).otherwise(F.col("content")), name: F.coalesce(F.col("_o.n"), F.lit(0)).cast("long")}).drop("_o")


def optimise(messages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """messages: request_seq, request_id, session_id, budget_mode, msg_idx, role, content. A row for each valid request: its
    tokens before and after, messages, counts and strategies in order.

    A request without a budget mode has the configured one. Sessions see their requests in order of request_seq: notes and code that came before are referred to. A request that
    the chain makes longer goes back to its redacted messages.
    """
    rows = conversation.valid_requests(messages, ["request_id"])
    rows = rows.withColumn("budget_mode", F.coalesce(F.nullif("budget_mode", F.lit("")), F.lit(config.default_budget)))
    rows = rows.withColumn("raw", sc.message_tokens(F.col("content"))).withColumn("_g", F.when(F.col("content").isNotNull(), text.redact(F.col("content"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = rows.withColumns({"content": F.col("_g.text"), "secrets_redacted": zero(F.col("_g.secrets")), "pii_redacted": zero(F.col("_g.emails")) + zero(F.col("_g.phones"))}).drop("_g")
    rows = rows.withColumn("redacted", F.col("content"))
    for name, _, role, op in BEFORE:
        rows = _apply(rows, name, role, op)
    rows = conversation.dedup_notes(rows, "session_id", ["request_seq", "msg_idx"])
    rows = conversation.prune_code(rows, "session_id", ["request_seq", "msg_idx"])
    for name, _, role, op in AFTER:
        rows = _apply(rows, name, role, op)
    counts = ["raw", "secrets_redacted", "pii_redacted", *(x[0] for x in BEFORE), *(x[0] for x in SESSION), *(x[0] for x in AFTER)]
    ordered = F.array_sort(F.collect_list(F.struct("msg_idx", "role", "content", "redacted")))
    wide = rows.groupBy(*KEYS).agg(ordered.alias("_m"), *(F.sum(c).cast("long").alias(c) for c in counts))
    plain = lambda field: F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m[field].alias("content")))
    wide = wide.withColumns({"messages": plain("content"), "redacted": plain("redacted")}).drop("_m").withColumnRenamed("raw", "raw_input_tokens")
    wide = wide.withColumn("cache_query", conversation.cache_query(F.col("redacted"))).withColumn("question_hash", sc.cache_key_hash(F.col("cache_query")))
    for (name, _), op in zip(HISTORY, (conversation.filter_history, conversation.summarize_history), strict=True):
        wide = wide.withColumn("_f", op(F.col("messages"))).withColumns({"messages": F.col("_f.messages"), name: F.col("_f.n")}).drop("_f")
    wide = wide.withColumn("budget_mode", sc.budget_mode(F.col("budget_mode"), F.col("raw_input_tokens")))
    wide = wide.withColumn("_s", conversation.shrink(F.col("messages"), F.col("budget_mode"), config.verbatim_turns))
    wide = wide.withColumns({"messages": F.col("_s.messages"), "turns_shrunk": F.col("_s.turns_shrunk"), "shrunk": F.col("_s.applied")}).drop("_s")
    total = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + sc.message_tokens(m["content"]))
    wide = wide.withColumn("_new", total).withColumn("reverted", F.col("_new") > F.col("raw_input_tokens"))
    done = [*((n, s) for n, s, *_ in BEFORE), *SESSION, *((n, s) for n, s, *_ in AFTER), *HISTORY]
    say = lambda test, name: F.when(test, F.lit(name))
    guard = [F.lit("guard_mode"), say(F.col("secrets_redacted") > 0, "secret_redaction"), say(F.col("pii_redacted") > 0, "pii_redaction")]
    chain = [say(F.col(n) > 0, s) for n, s in done] + [say(F.col("shrunk"), "conversation_shrinker"), F.when(F.col("budget_mode") != "normal", F.concat(F.lit("budget_"), F.col("budget_mode")))]
    some = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    strategies = F.when(F.col("reverted"), some([*guard, F.lit("optimization_reverted_no_savings")])).otherwise(some([*guard, *chain]))
    back = {n: F.when(F.col("reverted"), 0).otherwise(F.col(n)).cast("long") for n, _ in [*done, ("turns_shrunk", "")]}
    wide = wide.withColumn("strategies", strategies).withColumns(back)
    optimized = F.when(F.col("reverted"), F.col("raw_input_tokens")).otherwise(F.col("_new"))
    wide = wide.withColumns({"messages": F.when(F.col("reverted"), F.col("redacted")).otherwise(F.col("messages")), "optimized_input_tokens": optimized})
    return wide.withColumn("saved_input_tokens", F.greatest(F.lit(0), F.col("raw_input_tokens") - F.col("optimized_input_tokens"))).drop("_new", "redacted", "shrunk")


def receipts(optimised: DataFrame, hits: DataFrame, upstream: DataFrame, baseline: DataFrame) -> DataFrame:
    """A receipt for each request.

    hits: request_id, label, answer, model; upstream: request_id, attempts, answer, prompt_tokens, completion_tokens,
    finish_reason; baseline: output_baseline(). Of a hit nothing is sent: all its tokens are saved. Of a miss the
    provider's own counts are reported beside the estimate; a truncated answer saves nothing.
    """
    joined = optimised.join(hits.select("request_id", "label", F.col("answer").alias("_hit"), F.col("model").alias("_model")), "request_id", "left")
    joined = joined.join(upstream.withColumn("_w", cache.waterfall(F.col("attempts"))), "request_id", "left").join(F.broadcast(baseline))
    hit = F.coalesce(F.col("label") != "MISS", F.lit(False))
    out = F.when(hit, sc.text_tokens(F.col("_hit"))).otherwise(F.coalesce(F.nullif("completion_tokens", F.lit(0)), sc.text_tokens(F.coalesce("answer", F.lit("")))))
    cut = ~hit & F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    pick = lambda a, b: F.when(hit, a).otherwise(b)
    strategies = pick(
        F.concat(F.filter("strategies", lambda s: s.isin("guard_mode", "secret_redaction", "pii_redaction")), F.array(F.when(F.col("label") == "EXACT_HIT", "exact_cache").when(F.col("label") == "SOFT_HIT", "semantic_cache_soft").otherwise("semantic_cache"))),
        F.concat("strategies", F.array(F.lit("provider_proxy")), F.filter(F.array(F.when(F.col("_w.used_failover"), "provider_waterfall"), F.when(cut, "output_truncated")), lambda s: s.isNotNull())),
    )
    zeroed = {n: pick(F.lit(0), F.col(n)).cast("long") for n in [*(x[0] for x in BEFORE), *(x[0] for x in SESSION), *(x[0] for x in AFTER), *(x[0] for x in HISTORY), "turns_shrunk"]}
    df = joined.withColumns({"strategies": strategies, "output_tokens": out.cast("long"), "truncated": cut} | zeroed)
    saved_out = F.when(cut, 0).otherwise(sc.output_saved(F.col("budget_mode"), F.col("output_tokens"), F.col("baseline")))
    return df.withColumns({
        "cache": F.coalesce("label", F.lit("MISS")), "cache_hit": hit, "provider": pick(F.lit("cache"), F.col("_w.provider")), "failover_used": pick(F.lit(False), F.coalesce(F.col("_w.used_failover"), F.lit(False))),
        "optimized_input_tokens": pick(F.col("raw_input_tokens"), F.col("optimized_input_tokens")), "saved_tokens": pick(F.col("raw_input_tokens"), F.col("saved_input_tokens")),
        "upstream_input_tokens": pick(F.lit(0), F.coalesce(F.nullif("prompt_tokens", F.lit(0)), F.col("optimized_input_tokens"))).cast("long"),
        "upstream_token_source": pick(F.lit("cache"), F.when(F.col("prompt_tokens") > 0, "provider").otherwise("estimated")),
        "max_output_tokens": sc.output_cap(F.col("budget_mode")), "max_output_tokens_applied": ~hit & (F.col("budget_mode") == "critical"), "estimated_output_tokens_saved": saved_out.cast("long"),
        "output_savings_basis": F.col("basis"), "output_baseline_tokens": F.coalesce("baseline", F.lit(700)).cast("long"), "guard_mode": F.lit("enabled"),
    }).drop("label", "_hit", "_model", "_w", "attempts", "answer", "prompt_tokens", "completion_tokens", "basis", "baseline", "samples", "saved_input_tokens")


def tips(receipt: DataFrame) -> DataFrame:
    """Recommendations of live receipts."""
    return analytics.recommendations(receipt)


def headers(receipt: DataFrame, prefix: str = "x-gateway-") -> Column:
    """A map of response headers from a receipt's columns."""
    names = [c for c in receipt.columns if c not in ("messages", "cache_query", "question_hash")]
    value = lambda c: F.array_join(c, ",") if receipt.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    pairs = [x for c in names for x in (F.lit(prefix + c.replace("_", "-")), value(c))]
    return F.create_map(*pairs)
