"""Analytics over request logs and study events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.core import strip
from loomspan.functions.scalars import first_sentence, output_cap, output_saved

# The measures that are summed, daily quota and the forecast's constants.
SUMS = [
    "raw_input_tokens", "optimized_input_tokens", "upstream_input_tokens", "output_tokens", "saved_tokens", "failovers", "secrets_redacted",
    "pii_redacted", "notes_deduplicated", "turns_shrunk", "code_pruned", "logs_folded", "json_compressed",
]
SESSION_SUMS = SUMS[:8]
QUOTA, DEFAULT_AVERAGE, DEFAULT_LEFT, MIN_SAMPLES = 50_000, 350.0, 100, 5
#: Questions of a quiz.
QUIZ = 5


def _sums(names: list[str]) -> list[Column]:
    source = lambda n: F.col("failover_used").cast("int") if n == "failovers" else F.col(n)
    flags = [F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(F.col("cache_hit").cast("int")), F.lit(0)).cast("long").alias("cache_hits")]
    return flags + [F.coalesce(F.sum(source(n)), F.lit(0)).cast("long").alias(n) for n in names]


def _rates(df: DataFrame) -> DataFrame:
    rate = F.when(F.col("requests") > 0, F.col("cache_hits") / F.col("requests")).otherwise(0.0)
    return df.withColumn("cache_hit_rate", rate).withColumn("total_redactions", F.col("secrets_redacted") + F.col("pii_redacted"))


def live_metrics(log: DataFrame) -> DataFrame:
    """One row of totals; zeros for an empty log."""
    return _rates(log.agg(*_sums(SUMS)))


def session_stats(log: DataFrame) -> DataFrame:
    """The same for each session."""
    return _rates(log.groupBy("session_id").agg(*_sums(SESSION_SUMS)))


def budget_breakdown(log: DataFrame) -> DataFrame:
    return log.groupBy("budget_mode").agg(F.count(F.lit(1)).alias("requests"))


def top_strategies(log: DataFrame) -> DataFrame:
    """strategy, uses, rank: the most used first, then the one that came up first. A null list counts nothing."""
    rows = log.select("request_seq", F.posexplode("strategies").alias("at", "strategy"))
    used = rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("request_seq", "at")).alias("first"))
    rank = F.row_number().over(Window.orderBy(F.col("uses").desc(), "first"))
    return used.select("strategy", "uses", rank.cast("long").alias("rank"))


def quota_forecast(totals: DataFrame, quota: int = QUOTA) -> DataFrame:
    """totals: live_metrics(). What is left of the daily quota, for how long, and which mode to use."""
    df = totals.select("requests", (F.col("upstream_input_tokens") + F.col("output_tokens")).alias("used"))
    df = df.withColumn("remaining", F.greatest(F.lit(0), quota - F.col("used")).cast("long"))
    df = df.withColumn("average", F.when(F.col("requests") > 0, F.col("used") / F.col("requests")).otherwise(DEFAULT_AVERAGE))
    left = F.when(F.col("average") > 0, (F.col("remaining") / F.col("average")).cast("long")).otherwise(DEFAULT_LEFT)
    df = df.withColumn("questions_left", left).withColumn("burn", F.greatest(F.lit(100), (F.col("average") * 10).cast("long")))
    hours = F.bround(F.col("remaining") / F.col("burn"), 1)
    slow = F.bround(F.col("remaining") / (F.col("burn") * 0.45), 1)
    mode = F.when((F.col("used") > quota * 0.60) | (F.col("questions_left") < 20), "critical").otherwise("saving")
    said = F.concat(F.lit("At current pace, free quota lasts ~"), hours.cast("string"), F.lit(" hours. Switch to Critical Mode to extend to ~"), slow.cast("string"), F.lit(" hours."))
    return df.select(
        F.lit(quota).cast("long").alias("daily_token_quota"), F.col("used").alias("used_tokens"), F.col("remaining").alias("remaining_quota"),
        F.col("questions_left").alias("estimated_questions_left"), F.when(F.col("requests") > 0, (F.col("used") * 1.4).cast("long")).otherwise(0).cast("long").alias("projected_daily_tokens"),
        mode.alias("budget_mode_recommendation"), hours.alias("runway_hours"), slow.alias("runway_critical_hours"), said.alias("runway_message"),
    )


def output_baseline(log: DataFrame, least: int = MIN_SAMPLES) -> DataFrame:
    """baseline, basis, samples: the mean output of unconstrained answers, if there are enough of them."""
    seen = log.where("budget_mode = 'normal' and not cache_hit and output_tokens > 0")
    df = seen.agg(F.count(F.lit(1)).alias("samples"), F.bround(F.coalesce(F.avg("output_tokens"), F.lit(0.0)), 0).cast("long").alias("mean"))
    ok = (F.col("samples") >= least) & (F.col("mean") > 0)
    return df.select(F.when(ok, F.col("mean")).alias("baseline"), F.when(ok, "measured_avg").otherwise("default_baseline").alias("basis"), "samples")


def cache_label() -> Column:
    """The log's label, repaired from the strategies where a hit has none."""
    repaired = F.when(F.array_contains("strategies", "exact_cache"), "EXACT_HIT").when(F.array_contains("strategies", "semantic_cache_soft"), "SOFT_HIT").otherwise("HIT")
    blank = F.coalesce(F.col("cache"), F.lit("")).isin("", "MISS")
    return F.when(blank, F.when(F.col("cache_hit"), repaired).otherwise("MISS")).otherwise(F.col("cache"))


def session_timeline(log: DataFrame) -> DataFrame:
    """Every session's requests in order; position counts from 1."""
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("request_seq"))
    return log.select(
        "session_id", at.cast("long").alias("position"), "request_id", cache_label().alias("cache"), "provider", "model", "raw_input_tokens", "optimized_input_tokens",
        F.col("saved_tokens").alias("saved_input_tokens"), F.array_join("strategies", ",").alias("strategies"), F.coalesce("secrets_redacted", F.lit(0)).alias("secrets_redacted"),
        F.coalesce("pii_redacted", F.lit(0)).alias("pii_redacted"), F.coalesce("guard_mode", F.lit("enabled")).alias("guard_mode"), F.coalesce("budget_mode", F.lit("saving")).alias("budget_mode"),
        F.coalesce("code_pruned", F.lit(0)).alias("code_pruned"),
    )


def receipts(log: DataFrame, events: DataFrame) -> DataFrame:
    """The newest row of each request with its newest topic, cap and output savings. The savings use the default baseline,
    as stored receipts do; a live receipt uses the measured one."""
    row = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("request_seq").desc()))
    newest = log.withColumn("_row", row).where("_row = 1").drop("_row")
    topics = events.groupBy("request_id").agg(F.max_by("topic", "event_seq").alias("topic"))
    mode = F.coalesce(F.nullif("budget_mode", F.lit("")), F.lit("saving"))
    out = newest.join(topics, "request_id", "left").withColumn("budget_mode", mode)
    return out.withColumn("max_output_tokens", output_cap(F.col("budget_mode"))).withColumn("estimated_output_tokens_saved", output_saved(F.col("budget_mode"), F.coalesce("output_tokens", F.lit(0))))


def recommendations(receipt: DataFrame, key: str = "request_id") -> DataFrame:
    """receipt: a row a request, columns as in receipts() or some of them. A row for each tip: key, position, type, title,
    message, action.

    saved_tokens, failover_used, topic, repeat_count and struggling are read under these names, so that stored rows get
    the prompt, failover and study tips by what they hold.
    """
    have = set(receipt.columns)
    get = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    num = lambda c: get(c, 0).cast("long")
    text = lambda c: c.cast("string")
    cache, mode = F.upper(get("cache", "MISS")), F.lower(get("budget_mode", "saving"))
    out, raw, saved, notes, repeat = (num(c) for c in ("output_tokens", "raw_input_tokens", "saved_tokens", "notes_deduplicated", "repeat_count"))
    label = F.when(cache == "EXACT_HIT", "exact cache").otherwise("semantic cache")
    tip = lambda kind, title, message, action: F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), message.alias("message"), F.lit(action).alias("action"))
    times = F.when(repeat > 0, repeat).otherwise(2)
    # The tips' texts and limits.
    tips = F.array(
        F.when(cache.isin("HIT", "EXACT_HIT", "SOFT_HIT"), tip("cache", "Zero Upstream Token Cost", F.concat(F.lit("This response was fulfilled instantly from "), label, F.lit(" with 0 upstream API tokens billed.")), "Explore Similar Questions")),
        F.when((out > 250) | (mode == "normal"), tip("output_budget", "Use Hint / Critical Mode", F.concat(F.lit("This answer used "), text(out), F.lit(" output tokens. Critical/Hint Mode caps output to 120 tokens (~60% savings).")), "Switch to Critical Mode"))
        .when(mode == "critical", tip("output_budget", "Critical Hint Mode Active", F.concat(F.lit("Critical mode capped this output to "), text(out), F.lit(" tokens (saved ~"), text(num("estimated_output_tokens_saved")), F.lit(" tokens vs normal baseline).")), "Maintain Critical Budget")),
        F.when(get("struggling", False) | (repeat >= 2), tip("study", "Flashcards Ready", F.concat(F.lit("You've asked about '"), get("topic", "this topic"), F.lit("' "), text(times), F.lit(" times. Generate a 5-minute revision package and quiz.")), "Finish Session")),
        F.when(notes > 0, tip("notes", "Repeated Notes Compressed", F.concat(text(notes), F.lit(" repetitive note blocks in your session were replaced with compact reference tags.")), "Reuse Note Tags")),
        F.when(num("code_pruned") > 0, tip("code", "Code Diff Pruning Active", F.lit("Your updated code was sent upstream as a compact AST diff against your previous turn instead of resending the full file."), "Continue Iterating")),
        F.when(get("failover_used", False), tip("failover", "Provider Shield Active", F.concat(F.lit("Primary provider hit rate limits or downtime; the gateway seamlessly routed your query to "), get("provider", "backup provider"), F.lit(".")), "Check Provider Status")),
        F.when(num("logs_folded") > 0, tip("logs", "Terminal Noise Folded", F.concat(text(num("logs_folded")), F.lit(" repetitive log lines were folded, keeping error traces 100% intact.")), "Keep Pasting Logs")),
        F.when(num("json_compressed") > 0, tip("json", "JSON Losslessly Compacted", F.concat(text(num("json_compressed")), F.lit(" JSON blocks were stripped of indentation waste with zero data loss.")), "Send Raw JSON")),
        F.when((raw > 800) & (saved < raw * 0.20) & (cache == "MISS"), tip("prompt", "Shorter Prompt Tip", F.lit("Large prompt with low compression. Try asking: 'Explain in 5 bullets with 1 example' or uploading reference notes once."), "Apply Prompt Tip")),
    )
    rows = receipt.select(key, F.posexplode(F.filter(tips, lambda t: t.isNotNull())).alias("position", "t"))
    return rows.select(key, F.col("position").cast("long").alias("position"), "t.type", "t.title", "t.message", "t.action")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("session_id", "file_key").agg(F.max_by("code", "snapshot_seq").alias("code"))


def session_topics(events: DataFrame) -> DataFrame:
    """Each session's topics in order of first appearance."""
    first = events.groupBy("session_id", "topic").agg(F.min("event_seq").alias("first_seq"))
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("first_seq"))
    return first.select("session_id", "topic", at.cast("long").alias("position"))


def struggle(events: DataFrame) -> DataFrame:
    """For each event, how often its topic came before in the session, and whether that is a struggle."""
    before = Window.partitionBy("session_id", F.lower("topic")).orderBy("event_seq").rowsBetween(Window.unboundedPreceding, -1)
    repeat = F.count(F.lit(1)).over(before) + 1
    hits = F.coalesce(F.sum(F.col("cache_hit").cast("int")).over(before), F.lit(0))
    return events.select("session_id", "event_seq", "topic", repeat.cast("long").alias("repeat_count"), ((repeat >= 3) | (hits >= 2)).alias("struggling"))


def study_topics(events: DataFrame) -> DataFrame:
    """A row for each session and topic: questions, hits, whether it is weak, in order of first appearance."""
    rows = events.groupBy("session_id", "topic").agg(F.count(F.lit(1)).alias("questions"), F.sum(F.col("cache_hit").cast("int")).cast("long").alias("cache_hits"), F.min("event_seq").alias("first_seq"))
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("first_seq"))
    weak = (F.col("questions") >= 3) | (F.col("cache_hits") >= 2)
    return rows.select("session_id", "topic", at.cast("long").alias("position"), "questions", "cache_hits", weak.alias("weak"))


def flashcards(events: DataFrame) -> DataFrame:
    """A card for each question with an answer: topics by first appearance among those, then by event; quiz_id and the quiz
    question for the first five."""
    clean = lambda q: F.when(q.contains("Question:"), strip(F.regexp_replace(q, r"\A[\s\S]*?Question:", ""))).otherwise(q)
    rows = events.where("question <> '' and answer <> ''").withColumn("first_seq", F.min("event_seq").over(Window.partitionBy("session_id", "topic")))
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("first_seq", "event_seq"))
    rows = rows.withColumn("position", at.cast("long")).withColumn("asked", clean(F.col("question")))
    quiz = F.col("position") <= QUIZ
    return rows.select(
        "session_id", "position", "topic", F.col("asked").alias("question"), first_sentence(F.col("answer")).alias("answer"),
        F.when(quiz, F.col("position")).alias("quiz_id"), F.when(quiz, F.concat(F.lit("In "), "topic", F.lit(": "), "asked")).alias("quiz_question"),
    )


def study_packages(events: DataFrame, log: DataFrame) -> DataFrame:
    """A row for each session with events or requests: totals, topics, weak topics, cards, quiz and the revision sheet in
    Markdown. A session without events has empty lists, one without requests zeros."""
    topics, cards = study_topics(events), flashcards(events)
    nth = F.row_number().over(Window.partitionBy("session_id", "topic").orderBy("position"))
    first = cards.withColumn("nth", nth).where("nth <= 2").groupBy("session_id", "topic").agg(F.array_sort(F.collect_list(F.struct("nth", "question", "answer"))).alias("qa"))
    rows = topics.join(first, ["session_id", "topic"], "left")
    # words start with a capital after anything that isn't a letter
    title = F.array_join(F.transform(F.regexp_extract_all("topic", F.lit(r"(?U)[^\W\d_]+|[\W\d_]+"), F.lit(0)), lambda w: F.initcap(w)), "")
    lines = F.transform(F.coalesce("qa", F.array().cast("array<struct<nth:int,question:string,answer:string>>")), lambda x: F.concat(F.lit("- **Q**: "), x["question"], F.lit("\n  **Key Takeaway**: "), x["answer"], F.lit("\n")))
    weak = F.concat(F.lit("### "), title, F.lit("\n"), F.array_join(lines, ""))
    plain = F.concat(F.lit("- **"), title, F.lit("**: "), F.element_at("qa", 1)["answer"])
    rows = rows.withColumn("weak_md", F.when(F.col("weak"), weak)).withColumn("plain_md", F.when(~F.col("weak") & F.col("qa").isNotNull(), plain))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("position", F.col(c).alias("v"))))), lambda x: x["v"])
    rows = rows.withColumn("weak_topic", F.when(F.col("weak"), F.col("topic")))
    lists = ("topics", "weak_topics", "weak_md", "plain_md")
    pack = rows.groupBy("session_id").agg(*(ordered(c).alias(name) for c, name in zip(("topic", "weak_topic", "weak_md", "plain_md"), lists, strict=True)))
    card = F.struct("position", "topic", "question", "answer")
    quiz = F.when(F.col("quiz_id").isNotNull(), F.struct(F.col("quiz_id").alias("id"), "topic", F.col("quiz_question").alias("question"), "answer"))
    decks = cards.groupBy("session_id").agg(F.array_sort(F.collect_list(card)).alias("flashcards"), F.array_sort(F.collect_list(quiz)).alias("mini_quiz"))
    whole = log.select("session_id").unionAll(events.select("session_id")).distinct().join(pack, "session_id", "left").join(decks, "session_id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    kinds = {c: "array<string>" for c in lists} | {"flashcards": "array<struct<position:bigint,topic:string,question:string,answer:string>>", "mini_quiz": "array<struct<id:bigint,topic:string,question:string,answer:string>>"}
    whole = whole.select("session_id", *(none(c, kind) for c, kind in kinds.items()))
    studied = F.when(F.size("topics") > 0, F.array_join("topics", ", ")).otherwise("None")
    weak_part = F.when(F.size("weak_md") > 0, F.concat(F.lit("## ⚠️ Areas Needing Reinforcement (Struggling Topics)\n"), F.array_join("weak_md", "\n"))).otherwise("## ✅ Great Job! No persistent struggle patterns detected.\n")
    sheet = F.array_join(F.concat(F.array(F.concat(F.lit("# 5-Minute Revision Sheet — Session `"), F.col("session_id"), F.lit("`\n")), F.concat(F.lit("**Topics Studied**: "), studied, F.lit("\n")), weak_part, F.lit("## Quick Reference Summary")), F.col("plain_md")), "\n")
    stats = session_stats(log)
    totals = ["requests", "cache_hits", "saved_tokens", "raw_input_tokens", "upstream_input_tokens", "secrets_redacted", "pii_redacted", "total_redactions"]
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in totals]
    rate = F.bround(F.coalesce("cache_hit_rate", F.lit(0.0)), 4).alias("cache_hit_rate")
    return whole.join(stats, "session_id", "left").select("session_id", "topics", "weak_topics", sheet.alias("revision_sheet"), *zero, rate, "flashcards", "mini_quiz")


def finish_session(events: DataFrame, log: DataFrame, session_id: str) -> DataFrame:
    """One session's package; no row if it has neither events nor requests."""
    return study_packages(events.where(F.col("session_id") == session_id), log.where(F.col("session_id") == session_id))
