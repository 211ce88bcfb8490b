import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import code
from loomspan.functions import scalars as sc
from loomspan.functions import text
from loomspan.operators import analytics, cache, conversation, topics
from loomspan.sources import tables
from loomspan.streaming import replay


def test_thresholds_and_tiers(spark):
    assert cache.thresholds(0.9) == (0.9, 0.9) and cache.thresholds() == (0.95, 0.9)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.96, 0.28]), (3, [0.92, 0.39]), (4, [0.0, 0.0])], "query_id long, vector array<double>")
    entries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.0])], "entry_id long, vector array<double>")
    got = {r.query_id: (r.entry_id, r.label) for r in cache.best_vector(rows, entries).withColumn("label", cache.tier(F.col("similarity"))).collect()}
    assert got == {1: (7, "HIT"), 2: (7, "HIT"), 3: (7, "SOFT_HIT"), 4: (7, "MISS")}


def test_vector_scan_in_parts(spark):
    rows = spark.range(60).select((F.col("id") * 2 + 1).alias("query_id"), F.array(F.sin("id"), F.cos("id")).alias("vector"))
    entries = spark.range(90).select(F.col("id").alias("entry_id"), F.array(F.sin(F.col("id") % 45), F.cos(F.col("id") % 45)).alias("vector"))
    whole = {r.query_id: (r.entry_id, round(r.similarity, 9)) for r in cache.best_vector(rows, entries).collect()}
    parts = {r.query_id: (r.entry_id, round(r.similarity, 9)) for r in cache.best_vector(rows, entries, block=40).collect()}
    assert whole == parts and len(whole) == 60 and all(e < 45 for e, _ in whole.values())


def test_embedding(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT!"), (2, ""), (3, "... !!")], "k long, t string")
    terms = sc.embedding_terms(df, "k", "t")
    from hashlib import sha256

    want = [0.0] * 384
    for w in ("the", "cat", "the", "cat"):
        d = sha256(w.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 384] += 1 if d[4] % 2 == 0 else -1
    length = sum(x * x for x in want) ** 0.5
    got = {r.k: r.vector for r in sc.dense(terms, "k").collect()}
    assert set(got) == {1} and got[1] == pytest.approx([x / length for x in want])


def test_multipart_guard(spark):
    parts = [("text", "mail a@b.example", None), ("image_url", None, "{}"), ("text", "token: " + "x" * 20, None)]
    df = spark.createDataFrame([(parts,)], "parts array<struct<type:string,text:string,raw:string>>")
    got = df.select(text.redact_parts(F.col("parts")).alias("r")).first().r
    assert (got.secrets, got.pii) == (1, 1) and got.parts[0].text == "mail [REDACTED_EMAIL_1]" and got.parts[1].raw == "{}"


def test_bpe(spark, tmp_path):
    import base64

    from loomspan.functions import bpe

    tokens = [bytes([k]) for k in range(256)] + [b"th", b"the"]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    count = bpe.counter(str(tmp_path / "ranks"))
    df = spark.createDataFrame([("the",), ("then",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(count("c")).collect()] == [1, 2, 1, 0]


def test_plans(spark):
    """Columns and filters reach the scan; native operators run no Python; text operators don't shuffle."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = plan(docs.where("lang = 'en'").select("doc_id", text.redact(F.col("text"))["text"]))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in one and "n_chars" not in one and "source" not in one
    for op in (text.redact, text.dedup_sentences, text.compact_phrases, text.normalize_structure, text.describe_binary, text.strip_preamble):
        p = plan(docs.select(op(F.col("text"))))
        assert "Python" not in p and "Exchange" not in p


def test_dimension_mismatch(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different lengths"):
        df.select(sc.dot(F.col("a"), F.col("b"))).collect()


def test_code_pruning(spark):
    body = "def handle(x):\n" + "\n".join(f"    step_{k} = load({k})" for k in range(12))
    fence = lambda b: f"look\n```python server.py\n{b}\n```"
    rows = [("s", 1, fence(body)), ("s", 2, fence(body)), ("s", 3, fence(body.replace("load(5)", "save(5)"))), ("t", 1, fence(body)), ("s", 4, None)]
    got = conversation.prune_code(spark.createDataFrame(rows, "session string, at int, content string"), "session", ["at"]).orderBy("session", "at").collect()
    assert [r.code_pruned for r in got] == [0, 1, 1, 0, 0]
    assert "unchanged" in got[1].content and "+    step_5 = save(5)" in got[2].content and "Functions: [handle]" in got[2].content


def naive_prune(texts):
    """The latest snapshot of each name, text after text."""
    from difflib import SequenceMatcher, unified_diff

    known, out = {}, []
    for text in texts:
        new, n = text, 0
        for m in re.finditer(r"```([^\n`]*)\n([\s\S]*?)```", text or ""):
            code, words = m[2], m[1].split()
            if len(code.strip().splitlines()) < 5 or len(code.strip()) < 80:
                continue
            name = next((w for w in words[1:] if "." in w), None) or (x[1] if (x := re.search(r"# file: (\S+)", code)) else None)
            if name is None and (x := re.findall(r"\b[\w.-]+\.[a-z]{1,8}\b", text[max(0, m.start() - 150) : m.start()])):
                name = x[-1]
            name = name or f"{words[0]}_{re.search(r'(?:def|class|function) (\w+)', code)[1]}"
            alike = SequenceMatcher(None, known[name], code).ratio() if name in known else 0
            notice = None
            if alike >= 0.99:
                notice = f"[Code Reference: `{name}` is unchanged from previous turn]"
            else:
                if alike >= 0.4:
                    diff = "".join(list(unified_diff(known[name].splitlines(keepends=True), code.splitlines(keepends=True), n=1))[2:]).strip()
                    names = sorted(re.findall(r"def (\w+)", code))
                    about = f"AST Outline: Functions: [{', '.join(names)}]\n" if names else ""
                    notice = f"[Code Update for `{name}` (Diff vs previous turn)]:\n{about}```diff\n{diff}\n```"
                    notice = notice if len(notice) < len(m[0]) else None
                known[name] = code
            if notice:
                new, n = new.replace(m[0], notice, 1), n + 1
        out.append((new, n))
    return out


def test_code_pruning_against_the_definition(spark):
    """Several names and blocks a message, edits of every size, names from every place."""
    rng = np.random.default_rng(0)
    bodies = {k: [f"    {k}_{j} = load({j})" for j in range(14)] for k in ("a", "b", "c")}
    heads = {"a": "```python a.py\n", "b": "```python\n# file: b.py\n", "c": "```js\n"}
    sessions = {s: [] for s in "xyz"}
    for s in sessions:
        for _ in range(12):
            text = str(rng.choice(["look", "see old.txt and b.rb for", "nothing"])) + "\n"
            for k in rng.choice(list(bodies), rng.integers(0, 4)):
                for _ in range(int(rng.choice([0, 0, 1, 4, 13]))):
                    bodies[k][rng.integers(0, 14)] = f"    {k}_{rng.integers(0, 99)} = save({rng.integers(0, 99)})"
                text += f"{heads[k]}{'function' if k == 'c' else 'def'} f_{k}(x):\n" + "\n".join(bodies[k]) + "\n```\nthen " + str(rng.choice(["", "w.py "]))
            sessions[s].append(text)
        sessions[s] += [None, "no code", "```py\nshort\n```"]
    rows = [(s, at, t, 5) for s, texts in sessions.items() for at, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "session string, at int, content string, k0 int").repartition(3)
    got = {(r.session, r.at): (r.content, r.code_pruned) for r in conversation.prune_code(df, "session", ["at"]).collect()}
    for s, texts in sessions.items():
        assert [got[s, at] for at in range(len(texts))] == naive_prune(texts)
    assert sum(n for _, n in got.values()) > 10 and any("Code Update" in (t or "") for t, _ in got.values())


def test_file_key_precedence(spark):
    cases = [
        ("python a.py b.py", "# file: c.py\nx", "see d.py", "a.py"), ("python", "x\n# filename: c.py\n", "see d.py", "c.py"), ("js", "// c.js\nx", "see d.js", "c.js"),
        ("", "x = 1", "see d.py and e.f.txt now", "e.f.txt"), ("python", "import x\n\ndef g(): pass\nclass H: pass", "", "python_g"), ("Go", "func Run() {", "", "go_Run"),
        (None, "x", None, "code_snippet"), ("python end.", "class A", "", "python_A"), ("rust", "struct P;", "at the end.", "rust_P"),
    ]
    df = spark.createDataFrame(cases, "info string, code string, before string, want string")
    for r in df.select("*", code.file_key(F.col("info"), F.col("code"), F.col("before")).alias("got")).collect():
        assert r.got == r.want


def test_notes(spark):
    note = "word " * 50
    rows = [("s", 1, f"a\n\n{note}"), ("s", 2, f"b\n\n{note}"), ("t", 3, note), ("s", 4, f"{note}\n\n{note}"), ("s", 5, None)]
    df = spark.createDataFrame(rows, "session_id string, turn int, content string")
    got = {r.turn: r for r in conversation.dedup_notes(df, "session_id", ["turn"]).collect()}
    assert [got[k].notes_deduplicated for k in (1, 2, 3, 4, 5)] == [0, 1, 0, 2, 0]
    assert got[2].content.startswith("b\n\n[Reference: note_") and got[5].content is None


def test_stream_notes_agree_with_batch(spark, tmp_path):
    note = "word " * 50
    rows = [("s", k, f"{k}\n\n{note}") for k in range(5)] + [("t", 9, note)]
    df = spark.createDataFrame(rows, "session_id string, request_seq int, content string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = replay.dedup_notes(stream).writeStream.format("memory").queryName("noted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.request_seq: (r.content, r.notes_deduplicated) for r in spark.table("noted").collect()}
    want = {r.request_seq: (r.content, r.notes_deduplicated) for r in conversation.dedup_notes(df, "session_id", ["request_seq"]).collect()}
    assert got == want


def test_topics_cluster(spark):
    rows = [("s", 1, "What is normalization?"), ("s", 2, "Explain database normalization again"), ("s", 3, "why does quicksort recurse"), ("s", 4, ""), ("t", 1, "quicksort")]
    got = {(r.s, r.at): r.topic for r in topics.extract_topics(spark.createDataFrame(rows, "s string, at int, q string"), "s", "at", "q").collect()}
    assert got[("s", 1)] == "normalization" == got[("s", 2)] and got[("s", 3)] == "quicksort recurse" and got[("s", 4)] == "general" and got[("t", 1)] == "quicksort"


def test_topics_hold_on_to_words(spark):
    """Known topics are tried in order of appearance; a topic's own words may stand anywhere in a question."""
    rows = [("s", 1, "hash tables collide"), ("s", 2, "do tables of hash kind collide often"), ("s", 3, "tables"), ("s", 4, None), ("s", 5, "why is general relativity hard"), ("t", 1, "the of"), ("t", 2, "the of"), (None, 1, "heaps")]
    got = {(r.s, r.at): r.topic for r in topics.extract_topics(spark.createDataFrame(rows, "s string, at int, q string"), "s", "at", "q").collect()}
    assert [got["s", k] for k in range(1, 6)] == ["hash tables collide", "hash tables collide", "hash tables collide", "general", "general"]
    assert got["t", 1] == got["t", 2] == "the of" and got[None, 1] == "heaps"


def test_empty_log(spark):
    log = spark.createDataFrame([], tables.SCHEMAS["request_log"])
    totals = analytics.live_metrics(log)
    row = analytics.quota_forecast(totals).first()
    assert (row.remaining_quota, row.estimated_questions_left, row.budget_mode_recommendation) == (50_000, 142, "saving")
    assert analytics.output_baseline(log).first().basis == "default_baseline"
    assert analytics.study_packages(spark.createDataFrame([], tables.SCHEMAS["study_events"]), log).count() == 0


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(1, "r", "s")], "request_seq long, request_id string, session_id string").write.parquet(path)
    tables.append(spark.createDataFrame([(2, "q", "s", "critical")], "request_seq long, request_id string, session_id string, budget_mode string"), path, "request_log")
    got = {r.request_seq: r.budget_mode for r in tables.read_table(spark, path, "request_log").collect()}
    assert got[2] == "critical" and set(got) == {1, 2}


def test_requests_source(spark, tmp_path):
    import json

    ok = {"request_id": "a", "messages": [{"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image_url"}]}]}
    long = {"request_id": "b", "messages": [{"role": "user", "content": "x"}] * 51}
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, [ok, long, {**ok, "request_id": "c", "stream": True}])))
    got = tables.read_requests(spark, str(tmp_path / "r.json")).orderBy("msg_idx").select("*", sc.content_text(F.col("content"), F.col("parts")).alias("t")).collect()
    assert [(r.request_id, r.session_id, r.t) for r in got] == [("a", "default", "hi"), ("a", "default", "x")]


def test_config(spark):
    c = tables.EngineConfig.of({"threshold": "0.8", "verbatim_turns": "x"})
    assert (c.hard_threshold, c.soft_threshold, c.verbatim_turns) == (0.8, 0.8, 2)
    assert [p.name for p in c.providers] == ["google", "vercel", "groq"] and not any(p.configured for p in c.providers)
    with pytest.raises(ValueError, match="provider_2_model"):
        tables.providers({"provider_2_name": "n", "provider_2_base_url": "u", "provider_2_api_key": "k"})
    assert tables.dotenv("# c\nA=1\nB = 'x'\n", {"A": "0"}) == {"A": "0", "B": "x"}
    c = tables.EngineConfig.of({"kilo_api_key": "k", "groq_model": "m", "verify_soft_hits": " Off"})
    assert [(p.name, p.configured, p.model) for p in c.providers][2:] == [("kilo", True, "openrouter/free"), ("groq", False, "m")] and not c.verify_soft_hits
    one = {f"provider_1_{f}": f for f in ("name", "base_url", "api_key", "model")}
    spark.conf.set("spark.loomspan.soft_threshold", "0.7")
    try:
        assert tables.EngineConfig.from_session(spark).soft_threshold == 0.7
    finally:
        spark.conf.unset("spark.loomspan.soft_threshold")
    c = tables.EngineConfig.of(one)
    assert tables.provider_status(spark, c).collect()[0][1:] == ("name", True, "model")
    assert tables.health(spark, c).first().providers[0].name == "name"


def test_settings_take_effect(spark):
    from loomspan.plans import pipeline

    turns = [(1, "r", "s", None, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " + "about the very same subject of sorting lists " * 8) for k in range(7)]
    df = spark.createDataFrame(turns, "request_seq int, request_id string, session_id string, budget_mode string, msg_idx int, role string, content string")
    few = pipeline.optimise(df, tables.EngineConfig.of({"default_budget": "saving", "verbatim_turns": "1"})).first()
    many = pipeline.optimise(df, tables.EngineConfig.of({"default_budget": "critical", "verbatim_turns": "4"})).first()
    assert (few.budget_mode, many.budget_mode) == ("saving", "critical") and few.turns_shrunk > many.turns_shrunk
    asked = spark.createDataFrame([(1, "h", "reject")], "query_id int, question_hash string, verdict string")
    terms = spark.createDataFrame([(1, 5, 0.92)], "query_id int, idx int, w double")
    known = spark.createDataFrame([(7, "g")], "entry_id long, question_hash string")
    own = spark.createDataFrame([(7, 5, 1.0)], "entry_id long, idx int, w double")
    label = lambda **kw: cache.resolve(asked, known, terms, own, **kw).first().label
    assert [label(), label(verify=False), label(hard=0.9), label(soft=0.93)] == ["MISS", "SOFT_HIT", "HIT", "MISS"]


def test_insert_gives_ids(spark, tmp_path):
    path = str(tmp_path / "entries")
    one = tables.insert(spark.createDataFrame([("a", "h"), ("b", "g")], "question string, question_hash string"), path, "cache_entries", "entry_id").collect()
    two = tables.insert(spark.range(5).select(F.lit("c").alias("question")), path, "cache_entries", "entry_id").collect()
    ids = [r.entry_id for r in one + two]
    assert len(set(ids)) == 7 and min(r.entry_id for r in two) > max(r.entry_id for r in one) and tables.read_table(spark, path, "cache_entries").count() == 7


def test_sessions_without_events_or_requests(spark):
    """A package is made for whoever asked or studied, and for nobody else."""
    log = spark.createDataFrame([("r", True, 10, 4, 2, 1)], "session_id string, cache_hit boolean, raw_input_tokens long, saved_tokens long, secrets_redacted long, pii_redacted long")
    log = tables.conform(log, "request_log")
    events = tables.conform(spark.createDataFrame([(1, "e", "sorting", "How?", "So. And so.", False)], "event_seq long, session_id string, topic string, question string, answer string, cache_hit boolean"), "study_events")
    asked, studied = (analytics.finish_session(events, log, s).collect() for s in ("r", "e"))
    assert (asked[0].requests, asked[0].raw_input_tokens, asked[0].secrets_redacted, asked[0].pii_redacted, asked[0].topics, asked[0].flashcards) == (1, 10, 2, 1, [], [])
    assert "**Topics Studied**: None\n" in asked[0].revision_sheet
    assert (studied[0].requests, studied[0].cache_hit_rate, studied[0].topics) == (0, 0.0, ["sorting"])
    assert studied[0].mini_quiz[0].question == "In sorting: How?" and studied[0].flashcards[0].answer == "So."
    assert analytics.finish_session(events, log, "x").count() == 0


def test_catalog(spark):
    from hashlib import sha256

    from loomspan.plans import catalog

    catalog.register(spark, "/root/testdata/sf0.001")
    row = spark.sql("select text_tokens('abcdefgh') as t, cache_key_hash(' A  b ') as h, code_outline('class A: pass') as o, (select count(*) from region) as n").first()
    assert (row.t, row.h, row.o, row.n) == (2, sha256(b"a b").hexdigest(), "Classes: [A]", 5)


def test_receipts_hold_together(spark):
    from loomspan.plans.queries import QUERIES

    rows = QUERIES["live_receipts"](spark, "/root/testdata/sf0.001").collect()
    assert rows
    for r in rows:
        if r.cache_hit:
            assert (r.provider, r.upstream_input_tokens, r.saved_tokens, r.upstream_token_source) == ("cache", 0, r.raw_input_tokens, "cache")
        else:
            assert r.saved_tokens == r.raw_input_tokens - r.optimized_input_tokens and "provider_proxy" in r.strategies
            assert r.failover_used == ("provider_waterfall" in r.strategies)
        assert not r.truncated or r.estimated_output_tokens_saved == 0
