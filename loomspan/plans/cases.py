"""Queries that reach every branch of an operator: a row's key picks a case, and the SQL states the case's outcome, by hand.

The inputs are literals of this module, the outcomes too: nothing of an operator's own patterns or constants is used for them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import code, comments, pyops, text
from loomspan.functions import scalars as sc
from loomspan.operators import analytics, cache, conversation
from loomspan.plans import pipeline
from loomspan.plans.inputs import request_log, study_events, table
from loomspan.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _quoted(v: object) -> str:
    if v is None or isinstance(v, bool | int | float):
        return {None: "NULL", True: "true", False: "false"}.get(v, str(v)) if not isinstance(v, int | float) or isinstance(v, bool) else str(v)
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in v.split("\n"))


def _picked(values: Sequence, key: str = "p_partkey") -> Column:
    """The value of a row's case."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _stated(values: Sequence, name: str, kind: str = "", key: str = "p_partkey") -> str:
    cases = " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values))
    case = f"CASE {key} % {len(values)} {cases} END"
    return f"{f'CAST({case} AS {kind})' if kind else case} AS {name}"


def _texts(name: str, cases: Sequence[tuple[str, str, int]], op: Callable[[Column], Column]) -> None:
    """A query and its SQL for a text operator: (input, text, count)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "part").select("p_partkey", op(_picked([c[0] for c in cases])).alias("o"))
        return rows.select("p_partkey", F.col("o.text").alias("text"), F.col("o.n").alias("n"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT p_partkey, {_stated([c[1] for c in cases], 'text')}, {_stated([c[2] for c in cases], 'n', 'BIGINT')} FROM part"


_PAD = "w = compute_the_next_value(1)"
COMMENTS = [
    # // and /* */, strings and addresses
    (f'see\n```js\nconst a = "http://x"; // gone\n// all gone\n/* one\ntwo */\nlet b = "/* kept */";\n{_PAD}\n```', f'see\n```js\nconst a = "http://x";\n\nlet b = "/* kept */";\n{_PAD}\n```', 1),
    # -- in a language that has it, and none in one that hasn't
    (f"```sql\nSELECT a -- gone\n-- all gone\nFROM t WHERE b = '--kept'\n{_PAD}\n```", f"```sql\nSELECT a\nFROM t WHERE b = '--kept'\n{_PAD}\n```", 1),
    (f"```css\na {{ b: c; }} /* gone */\n{_PAD}\n```", f"```css\na {{ b: c; }} \n{_PAD}\n```", 1),
    (f"```html\n<p>x</p><!-- gone --><!--[if IE]>kept<![endif]-->\n{_PAD}\n```", f"```html\n<p>x</p><!--[if IE]>kept<![endif]-->\n{_PAD}\n```", 1),
    # docstrings and block comments of several lines; what a fence keeps, the pass over all of the text may still take
    (f'```py\ndef f(x):\n    """Adds one.\n\n    At length.\n    """\n    return x  # noqa\n{_PAD}\n```', f'```py\ndef f(x):\n    """Adds one."""\n    return x\n{_PAD}\n```', 2),
    (f"```java\n/** one line */\nint f;\n/**\n * Long.\n * @param x one\n */\nint g;\n{_PAD}\n```", f"```java\n/** one line */\nint f;\n\nint g;\n{_PAD}\n```", 1),
    # loose text: headings stay, notes go, and in what looks like Python all do
    ("# Heading\nsome text // gone\nsee https://a.b/c // kept", "# Heading\nsome text\nsee https://a.b/c // kept", 1),
    ("# TODO later\nplain words in a line of text", "plain words in a line of text", 1),
    ("import os  # gone\n## no heading here\nreturn os.name", "import os\nreturn os.name", 1),
    # nothing to do
    ("```py\nx = 1  # short\n```", "```py\nx = 1  # short\n```", 0),
    ("plain words without any mark of a note", "plain words without any mark of a note", 0),
]
_texts("comment_cases", COMMENTS, comments.strip_comments_column)

_HEAD = "Traceback (most recent call last):"


def _frames(n: int) -> list[str]:
    return [x for k in range(n) for x in (f'  File "a{k}.py", line {k}, in f', f"    call_number({k})")]


def _at(n: int, where: str = "B.java") -> list[str]:
    return [f"    at com.a.B.m{k}({where}:{k}1)" for k in range(n)]


TRACES = [
    ("\n".join([_HEAD, *_frames(7), "ValueError: x"]), "\n".join([_HEAD, *_frames(2), "    [... 3 more frames ...]", *_frames(7)[-4:], "ValueError: x"]), 6),
    ("\n".join([_HEAD, *_frames(2), "ValueError: a message that is long enough to be looked at"]), "\n".join([_HEAD, *_frames(2), "ValueError: a message that is long enough to be looked at"]), 0),
    ("\n".join(["Oops", *_at(15)]), "\n".join(["Oops", *_at(15)[:2], "    [... 11 more frames ...]", *_at(15)[-2:]]), 11),
    ("\n".join(["Oops, it broke", *_at(4), "and then it went on as if nothing had been"]), "\n".join(["Oops, it broke", *_at(4), "and then it went on as if nothing had been"]), 0),
    ("\n".join(["first line", _HEAD, *_frames(9), "KeyError: 1", "", *_at(6), "last line"]), "\n".join(["first line", _HEAD, *_frames(2), "    [... 5 more frames ...]", *_frames(9)[-4:], "KeyError: 1", "", *_at(2), "    [... 2 more frames ...]", *_at(6)[-2:], "last line"]), 12),
    ("\n".join(["start of the log", *(f"INFO step {k}" for k in range(12)), "ERROR: broken"]), "start of the log\n[Folded 12 terminal/log lines: 'INFO step 0' ... 'INFO step 11']\nERROR: broken", 12),
]
_texts("trace_cases", TRACES, pyops.fold_logs_column)

_A, _B = "a1B2c3D4e5" * 4, "Z9Y8X7W6V5" * 4
GUARD = [
    ("one vck" + "_" + _A + " two sk" + "-proj-" + _A + ".", "one [REDACTED_SECRET_1] two [REDACTED_SECRET_2].", 2, 0),
    ("gh" + "p_" + _A + " and gh" + "s_" + _B, "[REDACTED_SECRET_2] and [REDACTED_SECRET_1]", 2, 0),
    ("h" + "f_" + _A + " AI" + "za" + _A[:35] + " AK" + "IA" + "ABCDEFGH12345678", "[REDACTED_SECRET_1] [REDACTED_SECRET_2] [REDACTED_SECRET_3]", 3, 0),
    ("jwt ey" + "JhbGci.eyJzdWI.c2ln" + " and Bea" + "rer " + _B, "jwt [REDACTED_SECRET_1] and [REDACTED_SECRET_2]", 2, 0),
    ("api_key = '" + _A + "'", "api_key = '[REDACTED_SECRET_1]'", 1, 0),
    ("a@b.example, c.d@e.example or 555-123-4567", "[REDACTED_EMAIL_2], [REDACTED_EMAIL_1] or [REDACTED_PHONE_1]", 0, 3),
    ("nothing here but words and 12 numbers", "nothing here but words and 12 numbers", 0, 0),
    ("", "", 0, 0),
]


def guard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of the guard on every vendor's pattern."""
    c = _picked([g[0] for g in GUARD])
    rows = table(spark, sf_dir, "part").select("p_partkey", text.redact(c).alias("r"), text.redact_counts(c).alias("k"))
    return rows.select("p_partkey", "r.text", "r.secrets", (F.col("r.emails") + F.col("r.phones")).alias("pii"), F.col("k.secrets").alias("counted"), (F.col("k.emails") + F.col("k.phones")).alias("pii_counted"))


QUERIES["guard_cases"] = guard_cases
ORACLES["guard_cases"] = "SELECT p_partkey, " + ", ".join([_stated([g[1] for g in GUARD], "text"), *(_stated([g[at] for g in GUARD], name, "BIGINT") for at, name in ((2, "secrets"), (3, "pii"), (2, "counted"), (3, "pii_counted")))]) + " FROM part"

NAMES = [
    ("python a.py b.py", "# file: c.py\nx", "see d.py", "a.py"), ("python", "x\n# filename: c.py\n", "see d.py", "c.py"), ("js", "// c.js\nx", "see d.js", "c.js"),
    ("", "x = 1", "see d.py and e.f.txt now", "e.f.txt"), ("python", "import x\n\ndef g(): pass\nclass H: pass", "", "python_g"), ("Go", "func Run() {", "", "go_Run"),
    ("", "x", "", "code_snippet"), ("python end.", "class A", "", "python_A"), ("rust", "struct P;", "at the end.", "rust_P"),
]


def file_key_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    info, body, before = (_picked([n[k] for n in NAMES]) for k in range(3))
    return table(spark, sf_dir, "part").select("p_partkey", code.file_key(info, body, before).alias("file_key"))


QUERIES["file_key_cases"] = file_key_cases
ORACLES["file_key_cases"] = f"SELECT p_partkey, {_stated([n[3] for n in NAMES], 'file_key')} FROM part"

_BODY = [f"    step_{k} = load_the_part({k})" for k in range(14)]
_FIRST = "\n".join(["def handle(x):", *_BODY])
_EDIT = "\n".join(["def handle(x):", *_BODY[:6], "    written = [save(part) for part in open_parts(x)]", *_BODY[7:]])
_OTHER = "\n".join(["class Store:", *(f"    field_{k} = 'another value {k}'" for k in range(9))])
SNAPSHOTS = [
    (f"look\n```python server.py\n{_FIRST}\n```", f"look\n```python server.py\n{_FIRST}\n```", 0),
    (f"again\n```python server.py\n{_FIRST}\n```", "again\n[Code Reference: `server.py` is unchanged from previous turn]", 1),
    (f"now\n```python server.py\n{_EDIT}\n```\ndone", "now\n[Code Update for `server.py` (Diff vs previous turn)]:\nAST Outline: Functions: [handle]\n```diff\n@@ -7,3 +7,3 @@\n     step_5 = load_the_part(5)\n-    step_6 = load_the_part(6)\n+    written = [save(part) for part in open_parts(x)]\n     step_7 = load_the_part(7)\n```\ndone", 1),
    (f"else\n```python server.py\n{_OTHER}\n```", f"else\n```python server.py\n{_OTHER}\n```", 0),
    ("short\n```python server.py\nx = 1\n```", "short\n```python server.py\nx = 1\n```", 0),
    (f"in store.py then\n```python\n{_OTHER}\n```", f"in store.py then\n```python\n{_OTHER}\n```", 0),
    (f"same\n```python server.py\n{_OTHER}\n```", "same\n[Code Reference: `server.py` is unchanged from previous turn]", 1),
]


def code_snapshot_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a session of these messages, in order."""
    turns = F.array(*(F.lit(s[0]) for s in SNAPSHOTS))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), F.posexplode(turns).alias("turn", "content"))
    return conversation.prune_code(rows, "session_id", ["turn"])


QUERIES["code_snapshot_cases"] = code_snapshot_cases
ORACLES["code_snapshot_cases"] = f"SELECT s_suppkey AS session_id, t.turn, {_stated([s[1] for s in SNAPSHOTS], 'content', key='t.turn')}, {_stated([s[2] for s in SNAPSHOTS], 'code_pruned', 'BIGINT', 't.turn')} FROM supplier, (SELECT CAST(unnest(range({len(SNAPSHOTS)})) AS INT) AS turn) t"


def content_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and multipart content, a response's text, and a row as headers."""
    k = F.col("o_orderkey")
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    parts = F.array(part("text", F.concat(F.lit("order "), k.cast("string"))), part("image_url", F.lit(None).cast("string")), part("text", F.lit("and more")))
    content = F.when(k % 3 == 0, F.concat(F.lit("plain "), k.cast("string")))
    response = F.when(k % 2 == 0, F.concat(F.lit('{"choices": [{"message": {"role": "assistant", "content": "answer '), k.cast("string"), F.lit('"}}]}'))).otherwise('{"choices": []}')
    rows = table(spark, sf_dir, "orders").select(k, sc.content_text(content, F.when(k % 3 == 1, parts)).alias("content"), sc.assistant_text(response).alias("answer"), (k % 2 == 0).alias("cache_hit"), F.array(F.lit("a"), F.lit("b")).alias("strategies"))
    head = pipeline.headers(rows.select("o_orderkey", "cache_hit", "strategies"))
    return rows.select("o_orderkey", "content", "answer", F.array_join(F.array_sort(F.transform(F.map_entries(head), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("headers"))


QUERIES["content_cases"] = content_cases
ORACLES["content_cases"] = """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'plain ' || o_orderkey WHEN 1 THEN 'order ' || o_orderkey || ' and more' ELSE '' END AS content, CASE WHEN o_orderkey % 2 = 0 THEN 'answer ' || o_orderkey ELSE '' END AS answer,
  'x-gateway-cache-hit=' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ';x-gateway-o-orderkey=' || o_orderkey || ';x-gateway-strategies=a,b' AS headers FROM orders"""


def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to length one, their first numbers, and their products with themselves and with the first axis."""
    v = sc.normalize(F.transform("embedding", lambda x: x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    axis = F.transform("v", lambda _, i: F.when(i == 0, 2.0).otherwise(0.0))
    return rows.select("vec_id", F.round(sc.dot(F.col("v"), F.col("v")), 6).alias("self"), F.round(sc.dot(F.col("v"), axis), 6).alias("axis"), F.array_join(F.transform(sc.embed_preview(F.col("v"), 3), lambda x: F.format_string("%.4f", x)), ",").alias("preview"))


QUERIES["vector_normalize"] = vector_normalize
ORACLES["vector_normalize"] = """
WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM d)
SELECT vec_id, round(CASE WHEN l = 0 THEN 0 ELSE list_inner_product(e, e) / l / l END, 6) AS self, round(2 * e[1] / CASE WHEN l = 0 THEN 1 ELSE l END, 6) AS axis,
  array_to_string(list_transform(e[1:3], lambda x: printf('%.4f', x / CASE WHEN l = 0 THEN 1 ELSE l END)), ',') AS preview FROM n"""

_OPTIONS = [
    {}, {"threshold": "0.8"}, {"threshold": "0.97"}, {"hard_threshold": "0.9", "threshold": "0.7", "soft_threshold": "0.6"}, {"verify_soft_hits": " Off", "default_budget": "SAVING", "verbatim_turns": "4"},
    {"kilo_api_key": "k", "groq_model": "m"}, {"provider_1_name": "n", "provider_1_base_url": "u", "provider_1_api_key": "k", "provider_1_model": "m", "verbatim_turns": "-3"}, {"ollama_base_url": "http://o", "verbatim_turns": "many"},
]


def settings_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each nation by its key, with the providers' chain."""
    made = [tables.EngineConfig.of(o) for o in _OPTIONS]
    rows = [(k, c.hard_threshold, c.soft_threshold, c.default_budget, c.verify_soft_hits, c.verbatim_turns, ",".join(f"{p.name}:{p.model}:{'on' if p.configured else 'off'}" for p in c.providers)) for k, c in enumerate(made)]
    config = spark.createDataFrame(rows, "k long, hard double, soft double, budget string, verify boolean, turns int, providers string")
    return table(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(config), F.col("n_nationkey") % len(_OPTIONS) == F.col("k")).drop("k")


_CHAIN = "google:gemini-3.5-flash:off,vercel:openai/gpt-5.5:off"
_GROQ = "groq:llama-3.1-8b-instant:off"
QUERIES["settings_cases"] = settings_cases
ORACLES["settings_cases"] = "SELECT n_nationkey, " + ", ".join([
    _stated([0.95, 0.8, 0.97, 0.9, 0.95, 0.95, 0.95, 0.95], "hard", "DOUBLE", "n_nationkey"), _stated([0.9, 0.8, 0.9, 0.6, 0.9, 0.9, 0.9, 0.9], "soft", "DOUBLE", "n_nationkey"),
    _stated(["normal"] * 4 + ["saving"] + ["normal"] * 3, "budget", key="n_nationkey"), _stated([True] * 4 + [False] + [True] * 3, "verify", key="n_nationkey"), _stated([2, 2, 2, 2, 4, 2, 0, 2], "turns", "INT", "n_nationkey"),
    _stated([f"{_CHAIN},{_GROQ}"] * 5 + [f"{_CHAIN},kilo:openrouter/free:on,groq:m:off", "n:m:on", f"{_CHAIN},ollama:gpt-oss:20b:off,{_GROQ}"], "providers", key="n_nationkey"),
]) + " FROM nation"


def table_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older request log under today's columns."""
    old = table(spark, sf_dir, "events").selectExpr("event_id AS request_seq", "'r' || CAST(event_id AS STRING) AS request_id", "CAST(event_id % 9 AS INT) AS output_tokens", "event_type AS left_out")
    now = tables.conform(old, "request_log")
    return now.select("request_seq", "request_id", "output_tokens", "guard_mode", "budget_mode", "cache", "code_pruned", "comments_stripped", "phrases_compacted", "provider", F.size("strategies").alias("strategies"), F.lit(len(now.columns)).alias("width"))


QUERIES["table_migration"] = table_migration
ORACLES["table_migration"] = """
SELECT event_id AS request_seq, 'r' || event_id AS request_id, CAST(event_id % 9 AS BIGINT) AS output_tokens, 'enabled' AS guard_mode, 'saving' AS budget_mode, 'MISS' AS "cache", CAST(0 AS BIGINT) AS code_pruned,
  CAST(0 AS BIGINT) AS comments_stripped, CAST(0 AS BIGINT) AS phrases_compacted, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS INT) AS strategies, 27 AS width FROM events"""


def finish_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session's package."""
    pack = analytics.finish_session(study_events(spark, sf_dir), request_log(spark, sf_dir), "s1")
    return pack.select("session_id", F.array_join("topics", ",").alias("topics"), "requests", "cache_hits", "raw_input_tokens", "upstream_input_tokens", F.size("flashcards").alias("cards"), F.size("mini_quiz").alias("quiz"))


QUERIES["finish_session"] = finish_session

# (session's messages, what the chain makes of the last one, its count column, its strategy)
_LOG = "\n".join(f"INFO step {k} of the long build is done" for k in range(12))
_LOGGED = "[Folded 12 terminal/log lines: 'INFO step 0 of the long build is done' ... 'INFO step 11 of the long build is done']"
_JSON = "[\n" + ",\n".join(f'  {{"id": {k}, "name": "course number {k}"}}' for k in range(6)) + "\n]"
_SAME = "The quick brown fox jumps over the lazy dog."
CHAIN = [
    ("plain question about sorting", "plain question about sorting", ""),
    (f"{_SAME} {_SAME} {_SAME} Why?", f"{_SAME} [x3]\nWhy?", "sentence_deduplication"),
    (f"the build said\n{_LOG}\nERROR: broken", f"the build said\n{_LOGGED}\nERROR: broken", "log_folding"),
    (f"```json\n{_JSON}\n```", '```json\n[Array of 6 objects, schema: {id, name}]\nSample[0]: {"id":0,"name":"course number 0"}\nSample[1]: {"id":1,"name":"course number 1"}\n[...4 more items with same structure]\n```', "json_compression"),
    ("note that due to the fact that it rains we stay inside", "note that because it rains we stay inside", "phrase_compaction"),
    ("read https://a.example/p?utm_source=news&q=1 and tell", "read https://a.example/p?q=1 and tell", "structural_normalization"),
    ("my mail is a.long.address@some.example today", "my mail is [REDACTED_EMAIL_1] today", "pii_redaction"),
]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a request of one message, in a session of its own."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("request_seq"), F.concat(F.lit("r"), k.cast("string")).alias("request_id"), F.concat(F.lit("s"), k.cast("string")).alias("session_id"))
    mode = F.when(F.col("request_seq") % 2 == 0, "normal")
    return rows.select("*", mode.alias("budget_mode"), F.lit(0).alias("msg_idx"), F.lit("user").alias("role"), _picked([c[0] for c in CHAIN], "request_seq").alias("content"))


def pipeline_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on requests that fire one step each."""
    done = pipeline.optimise(_requests(spark, sf_dir))
    last = F.element_at("messages", 1)["content"]
    return done.select("request_id", "budget_mode", "raw_input_tokens", "optimized_input_tokens", "saved_input_tokens", "reverted", F.array_join("strategies", ",").alias("strategies"), last.alias("content"), "pii_redacted")


def _tokens(c: str) -> str:
    return f"(greatest(1, length({c}) // 4) + 4)"


_MADE = f"""
q AS (SELECT c_custkey AS k, {_stated([c[0] for c in CHAIN], 'raw', key='c_custkey')}, {_stated([c[1] for c in CHAIN], 'made', key='c_custkey')}, {_stated([c[2] for c in CHAIN], 'step', key='c_custkey')} FROM customer),
t AS (SELECT *, CAST({_tokens('raw')} AS BIGINT) AS r, CAST({_tokens('made')} AS BIGINT) AS o FROM q),
d AS (SELECT *, o > r AS back, step = 'pii_redaction' AS pii FROM t),
p AS (SELECT *, CASE WHEN back AND NOT pii THEN r ELSE least(o, r) END AS n, concat_ws(',', 'guard_mode', CASE WHEN pii THEN 'pii_redaction' END, CASE WHEN back THEN 'optimization_reverted_no_savings' WHEN step <> '' AND NOT pii THEN step END) AS done FROM d)
"""
QUERIES["pipeline_cases"] = pipeline_cases
ORACLES["pipeline_cases"] = f"""
WITH {_MADE}
SELECT 'r' || k AS request_id, 'normal' AS budget_mode, r AS raw_input_tokens, n AS optimized_input_tokens, r - n AS saved_input_tokens, back AS reverted, done AS strategies, CASE WHEN back AND NOT pii THEN raw ELSE made END AS content,
  CAST(pii AS BIGINT) AS pii_redacted FROM p"""


def receipt_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of those requests: hits of each kind, misses with and without the provider's counts, failover, truncation."""
    done = pipeline.optimise(_requests(spark, sf_dir))
    k = F.col("request_seq")
    hits = done.where(k % 4 == 0).select("request_id", F.when(k % 3 == 0, "EXACT_HIT").when(k % 3 == 1, "SOFT_HIT").otherwise("HIT").alias("label"), F.lit("a stored answer").alias("answer"), F.lit("m0").alias("model"))
    tried = lambda name, status: F.struct(F.lit(name).alias("provider"), status.alias("status"))
    attempts = F.array(tried("a", F.when(k % 3 == 0, 429).otherwise(200)), tried("b", F.lit(200)))
    upstream = done.select("request_id", attempts.alias("attempts"), F.lit("an answer from a provider").alias("answer"), F.when(k % 2 == 1, k + 7).cast("long").alias("prompt_tokens"), F.when(k % 5 == 1, 9).cast("long").alias("completion_tokens"), F.when(k % 5 == 0, "length").otherwise("stop").alias("finish_reason"))
    baseline = spark.createDataFrame([(40, "measured", 6)], "baseline long, basis string, samples long")
    out = pipeline.receipts(done, hits, upstream, baseline)
    return out.select("request_id", "cache", "cache_hit", "provider", "failover_used", "raw_input_tokens", "optimized_input_tokens", "upstream_input_tokens", "upstream_token_source", "saved_tokens", "output_tokens", "truncated", "estimated_output_tokens_saved", "output_savings_basis", F.array_join("strategies", ",").alias("strategies"))


QUERIES["receipt_cases"] = receipt_cases
ORACLES["receipt_cases"] = f"""
WITH {_MADE},
h AS (SELECT *, k % 4 = 0 AS hit, k % 4 <> 0 AND k % 5 = 0 AS cut, CASE k % 3 WHEN 0 THEN 'EXACT_HIT' WHEN 1 THEN 'SOFT_HIT' ELSE 'HIT' END AS label FROM p)
SELECT 'r' || k AS request_id, CASE WHEN hit THEN label ELSE 'MISS' END AS "cache", hit AS cache_hit, CASE WHEN hit THEN 'cache' WHEN k % 3 = 0 THEN 'b' ELSE 'a' END AS provider, NOT hit AND k % 3 = 0 AS failover_used,
  r AS raw_input_tokens, CASE WHEN hit THEN r ELSE n END AS optimized_input_tokens, CASE WHEN hit THEN 0 WHEN k % 2 = 1 THEN k + 7 ELSE n END AS upstream_input_tokens,
  CASE WHEN hit THEN 'cache' WHEN k % 2 = 1 THEN 'provider' ELSE 'estimated' END AS upstream_token_source, CASE WHEN hit THEN r ELSE r - n END AS saved_tokens,
  CAST(CASE WHEN hit THEN 3 WHEN k % 5 = 1 THEN 9 ELSE 6 END AS BIGINT) AS output_tokens, cut AS truncated, CAST(0 AS BIGINT) AS estimated_output_tokens_saved, 'measured' AS output_savings_basis,
  CASE WHEN hit THEN concat_ws(',', 'guard_mode', CASE WHEN pii THEN 'pii_redaction' END, CASE label WHEN 'EXACT_HIT' THEN 'exact_cache' WHEN 'SOFT_HIT' THEN 'semantic_cache_soft' ELSE 'semantic_cache' END)
    ELSE concat_ws(',', done, 'provider_proxy', CASE WHEN k % 3 = 0 THEN 'provider_waterfall' END, CASE WHEN cut THEN 'output_truncated' END) END AS strategies FROM h"""


def tier_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at chosen angles to two entries, under each pair of thresholds."""
    k = F.col("p_partkey")
    angle = F.radians(k % 40)
    asked = table(spark, sf_dir, "part").select(k.alias("query_id"), F.array(F.cos(angle), F.sin(angle)).alias("vector"))
    entries = spark.createDataFrame([(9, [1.0, 0.0]), (4, [1.0, 0.0]), (7, [0.0, 1.0])], "entry_id long, vector array<double>")
    found = cache.best_vector(asked, entries)
    label = F.lit(None).cast("string")
    for case, pair in enumerate((cache.thresholds(), cache.thresholds(0.85), cache.thresholds(None, 0.99, 0.8))):
        label = F.when(F.col("query_id") % 3 == case, cache.tier(F.col("similarity"), *pair)).otherwise(label)
    return found.select("query_id", "entry_id", label.alias("label"))


QUERIES["tier_cases"] = tier_cases
ORACLES["tier_cases"] = """
WITH s AS (SELECT p_partkey AS k, cos(radians(p_partkey % 40)) AS c FROM part)
SELECT k AS query_id, CAST(4 AS BIGINT) AS entry_id, CASE k % 3 WHEN 0 THEN CASE WHEN c >= 0.95 THEN 'HIT' WHEN c >= 0.9 THEN 'SOFT_HIT' ELSE 'MISS' END WHEN 1 THEN CASE WHEN c >= 0.85 THEN 'HIT' ELSE 'MISS' END
  ELSE CASE WHEN c >= 0.99 THEN 'HIT' WHEN c >= 0.8 THEN 'SOFT_HIT' ELSE 'MISS' END END AS label FROM s"""
