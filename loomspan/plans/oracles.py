"""The registered queries in SQL for DuckDB, from the same tables."""

from __future__ import annotations

from loomspan.plans import cases, fixed
from loomspan.plans.inputs import REQUEST_LOG, STUDY_EVENTS, sql

_LOG = f"log AS ({sql(REQUEST_LOG)})"
_STUDY = f"ev AS ({sql(STUDY_EVENTS)})"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_quote(w) for w in words) + "]"


def _tokens(c: str) -> str:
    return f"greatest(1, length({c}) // 4)"


def _collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _tier(s: str, hard: float, soft: float) -> str:
    return f"CASE WHEN {s} >= {hard} THEN 'HIT' WHEN {s} >= {soft} THEN 'SOFT_HIT' ELSE 'MISS' END"


def _cap(m: str) -> str:
    return f"CAST(CASE {m} WHEN 'normal' THEN 700 WHEN 'saving' THEN 300 WHEN 'critical' THEN 120 ELSE 300 END AS BIGINT)"


def _tag(c: str, pattern: str, kind: str, before: str = "", after: str = "") -> str:
    """Matches replaced by numbered tags, the last one first."""
    marked = rf"string_split(regexp_replace({c}, {_quote(pattern)}, '{before}' || chr(1) || '{after}', 'g'), chr(1))"
    return f"(SELECT array_to_string(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || '[REDACTED_{kind}_' || (len(p) - i) || ']' ELSE x END), '') FROM (SELECT {marked} AS p))"


def _hits(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {_quote(pattern)}))"


_GUARD = f"""
WITH s AS (SELECT doc_id, {_hits('text', fixed.KEY_VALUE)} AS secrets, {_tag('text', fixed.KEY_VALUE, 'SECRET', chr(92) + '1', chr(92) + '3')} AS t FROM documents),
m AS (SELECT doc_id, secrets, {_hits('t', fixed.EMAIL)} AS mails, {_tag('t', fixed.EMAIL, 'EMAIL')} AS t FROM s)
SELECT doc_id, secrets, mails, {_hits('t', fixed.PHONE)} AS phones, {_tag('t', fixed.PHONE, 'PHONE')} AS t FROM m
"""

_EMBED = r"""
tok AS (SELECT k, lower(trim(w, '.,!?;:()[]{}"''')) AS w FROM (SELECT k, unnest(regexp_split_to_array(t, '\s+')) AS w FROM src)),
cnt AS (SELECT k, w, count(*) AS n, sha256(w) AS h FROM tok WHERE w <> '' GROUP BY k, w),
sm AS (SELECT k, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 384 AS idx, sum(n * CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM cnt GROUP BY 1, 2),
ln AS (SELECT k, sqrt(CAST(sum(v * v) AS DOUBLE)) AS l FROM sm WHERE v <> 0 GROUP BY k),
emb AS (SELECT sm.k, sm.idx, CAST(sm.v AS DOUBLE) / ln.l AS w FROM sm JOIN ln ON sm.k = ln.k WHERE sm.v <> 0)
"""

_TOP1 = """
SELECT query_id, entry_id, similarity FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS entry_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rn
  FROM embeddings a JOIN embeddings b ON a.vec_id % 2 <> 0 AND b.vec_id % 2 = 0
) WHERE rn = 1
"""

_RESOLVED = f"""
src AS (SELECT doc_id AS k, text AS t FROM documents), {_EMBED},
d AS (SELECT doc_id, sha256({_collapse('lower(text)')}) AS h FROM documents),
ex AS (SELECT h, max(doc_id) AS exact_id FROM d WHERE doc_id % 2 = 0 GROUP BY h),
q AS (SELECT d.doc_id AS query_id, ex.exact_id FROM d LEFT JOIN ex ON d.h = ex.h WHERE d.doc_id % 2 <> 0),
sim AS (SELECT a.k AS query_id, b.k AS entry_id, round(sum(a.w * b.w), 9) AS s FROM emb a JOIN emb b ON a.idx = b.idx WHERE a.k % 2 <> 0 AND b.k % 2 = 0 GROUP BY 1, 2),
top AS (SELECT query_id, entry_id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) AS rn FROM sim) WHERE rn = 1),
l AS (SELECT q.query_id, q.exact_id, top.entry_id, top.s, CASE WHEN q.exact_id IS NOT NULL THEN 'EXACT_HIT' ELSE {_tier('coalesce(top.s, 0)', 0.95, 0.9)} END AS found FROM q LEFT JOIN top ON q.query_id = top.query_id),
r AS (SELECT *, found = 'SOFT_HIT' AND query_id % 3 = 0 AS rejected FROM l),
res AS (SELECT query_id, CASE WHEN rejected THEN 'MISS' ELSE found END AS label, CASE WHEN exact_id IS NOT NULL THEN exact_id WHEN NOT rejected AND found <> 'MISS' THEN entry_id END AS entry_id,
  CASE WHEN exact_id IS NOT NULL THEN 1.0 WHEN NOT rejected AND found <> 'MISS' THEN s END AS similarity, rejected FROM r)
"""

# Conversations with the position of the latest question and the size.
_CONV = """
base AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
conv AS (SELECT *, max(CASE WHEN role = 'user' THEN p ELSE 0 END) OVER (PARTITION BY conv_id) AS u, max(CASE WHEN role = 'assistant' THEN p ELSE 0 END) OVER (PARTITION BY conv_id) AS la FROM base)
"""

_MODE = "['saving', 'critical', 'normal'][conv_id % 3 + 1]"
_SUMMARY = rf"""CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'AI' ELSE role END || ': ' ||
  CASE WHEN length({_collapse('text')}) > 90 THEN regexp_replace(left({_collapse('text')}, 90), ' [^ ]*$', '') || '...' ELSE {_collapse('text')} END"""
_DIRECTIVE = "CASE mode " + " ".join(f"WHEN '{k}' THEN {_quote(v)}" for k, v in fixed.DIRECTIVES.items()) + " ELSE '' END"
_SHRUNK = f"""
{_CONV},
tot AS (SELECT conv_id, sum({_tokens('text')} + 4) AS raw FROM conv GROUP BY conv_id),
md AS (SELECT conv_id, raw, CASE WHEN raw >= 4000 THEN 'critical' WHEN raw >= 2000 AND {_MODE} = 'normal' THEN 'saving' ELSE {_MODE} END AS mode FROM tot),
dr AS (SELECT *, {_DIRECTIVE} AS told FROM md),
hist AS (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) AS back FROM conv c WHERE p < u AND role <> 'system'),
agg AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE back > 2) AS older, string_agg('- ' || {_SUMMARY}, chr(10) ORDER BY p) FILTER (WHERE back > 2) AS lines,
  coalesce(sum({_tokens('text')} + 4) FILTER (WHERE back <= 2), 0) AS kept_tokens FROM hist GROUP BY conv_id),
sy AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY p) FILTER (WHERE p < u AND role = 'system' AND text <> '') AS sys,
  max(u) AS u, max(n) AS n, max(CASE WHEN p = 1 THEN role END) AS r1, max(CASE WHEN p = 1 THEN text END) AS t1,
  sum({_tokens('text')} + 4) FILTER (WHERE p >= u) AS rest_tokens FROM conv GROUP BY conv_id),
al AS (SELECT dr.conv_id, dr.raw, dr.mode, dr.told, sy.u, sy.n, sy.r1, sy.t1, coalesce(agg.older, 0) AS older, coalesce(agg.turns, 0) AS turns, coalesce(agg.kept_tokens, 0) AS kept_tokens, sy.rest_tokens,
  concat_ws(chr(10) || chr(10), '[System Instructions]' || chr(10) || sy.sys, nullif(dr.told, ''), '[Earlier Conversation Summary]' || chr(10) || agg.lines) AS head
  FROM dr JOIN sy ON dr.conv_id = sy.conv_id LEFT JOIN agg ON dr.conv_id = agg.conv_id),
big AS (SELECT *, u > 0 AND n > 2 AS long, {_strip('head')} AS h FROM al),
fin AS (SELECT conv_id, mode, raw, long, told, u, n, r1, t1,
  CASE WHEN long THEN older ELSE 0 END AS shrunk, CASE WHEN long THEN least(turns, 2) ELSE 0 END AS kept,
  CASE WHEN long THEN CASE WHEN h <> '' THEN h END WHEN told = '' THEN NULL WHEN r1 = 'system' THEN {_strip("t1 || chr(10) || chr(10) || told")} ELSE told END AS made,
  CASE WHEN long THEN CASE WHEN h <> '' THEN 1 ELSE 0 END + least(turns, 2) + n - u + 1 WHEN told <> '' AND r1 <> 'system' THEN n + 1 ELSE n END AS messages,
  CASE WHEN long THEN kept_tokens + rest_tokens WHEN told <> '' AND r1 = 'system' THEN raw - ({_tokens('t1')} + 4) ELSE raw END AS other FROM big),
shr AS (SELECT *, other + CASE WHEN made IS NOT NULL THEN {_tokens('made')} + 4 ELSE 0 END AS optimized FROM fin)
"""

_METRICS = ", ".join(
    f"CAST(coalesce(sum({'CAST(failover_used AS INT)' if n == 'failovers' else n}), 0) AS BIGINT) AS {n}"
    for n in "raw_input_tokens optimized_input_tokens upstream_input_tokens output_tokens saved_tokens failovers secrets_redacted pii_redacted notes_deduplicated turns_shrunk code_pruned logs_folded json_compressed".split()
)
_SESSION_METRICS = _METRICS[: _METRICS.index(", CAST(coalesce(sum(notes_deduplicated")]
_COMMON = "count(*) AS requests, CAST(sum(CAST(cache_hit AS INT)) AS BIGINT) AS cache_hits, "
_RATES = "cache_hits / requests AS cache_hit_rate, secrets_redacted + pii_redacted AS total_redactions"

_RECEIPT = f"""
{_LOG}, {_STUDY},
nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY request_seq DESC) AS rn FROM log) WHERE rn = 1),
tp AS (SELECT request_id, arg_max(topic, event_seq) AS topic FROM ev GROUP BY request_id),
rc AS (SELECT nw.*, tp.topic, {_cap('budget_mode')} AS max_output_tokens, CAST(CASE WHEN budget_mode = 'normal' THEN 0 ELSE greatest(0, 700 - output_tokens) END AS BIGINT) AS estimated_output_tokens_saved
  FROM nw LEFT JOIN tp ON nw.request_id = tp.request_id)
"""

_KEYWORDS = f"list_filter(list_distinct(regexp_extract_all(lower(%s), '[a-zA-Z0-9_]{{3,}}')), lambda w: NOT list_contains({_list(fixed.CONVERSATION_STOP_WORDS)}, w))"

_SENT = r"string_split(regexp_replace(regexp_replace(%s, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1), 'g'), chr(1))"


def _phrases() -> str:
    out = "'In order to begin, due to the fact that it helps: ' || text || ' I really need to know it as well as a number of things.'"
    for phrase, short in sorted(fixed.PHRASES, key=lambda x: -len(x[0])):
        out = rf"regexp_replace({out}, {_quote(chr(92) + 'b' + phrase + chr(92) + 'b')}, {_quote(short)}, 'gi')"
    return f"SELECT doc_id, regexp_replace({out}, '  +', ' ', 'g') AS text FROM documents"


def _folded(line: str) -> str:
    """Folds runs of noise and then runs of repeated lines, per user. A line is noise if it tells of INFO and isn't critical."""
    preview = lambda c: f"CASE WHEN length({c}) > 60 THEN left({c}, 57) || '...' ELSE {c} END"
    sig = (
        r"trim(regexp_replace(regexp_replace(regexp_replace(l, '^\[?\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\]?\s*', ''), '_\d+\b', '', 'g'), '\b\d+\b', '', 'g'))"
    )
    return rf"""
WITH ln AS (SELECT user_id, event_id AS p, {line} AS l FROM events),
nz AS (SELECT *, regexp_matches(l, '(?i)\binfo\b') AND NOT regexp_matches(l, '(?i)\b(error|failed)\b') AS noise FROM ln),
ch AS (SELECT *, CASE WHEN noise = lag(noise) OVER (PARTITION BY user_id ORDER BY p) THEN 0 ELSE 1 END AS c FROM nz),
isl AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY p) AS g FROM ch),
grp AS (SELECT *, count(*) OVER (PARTITION BY user_id, g) AS k, first_value(l) OVER (PARTITION BY user_id, g ORDER BY p) AS f, first_value(l) OVER (PARTITION BY user_id, g ORDER BY p DESC) AS z, row_number() OVER (PARTITION BY user_id, g ORDER BY p) AS rn FROM isl),
mid AS (SELECT user_id, p, CASE WHEN noise AND k >= 3 THEN '[Folded ' || k || ' terminal/log lines: ''' || {preview('f')} || ''' ... ''' || {preview('z')} || ''']' ELSE l END AS l, CASE WHEN noise AND k >= 3 THEN k ELSE 0 END AS gone FROM grp WHERE NOT (noise AND k >= 3) OR rn = 1),
sg AS (SELECT *, CASE WHEN regexp_matches(l, '(?i)\b(ERROR|WARN|INFO)\b') THEN {sig} ELSE '' END AS s FROM mid),
c2 AS (SELECT *, CASE WHEN s <> '' AND s = lag(s) OVER (PARTITION BY user_id ORDER BY p) THEN 0 ELSE 1 END AS c FROM sg),
i2 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY p) AS g FROM c2),
g2 AS (SELECT *, count(*) OVER (PARTITION BY user_id, g) - 1 AS k, row_number() OVER (PARTITION BY user_id, g ORDER BY p) AS rn FROM i2),
fi AS (SELECT user_id, p, rn, k, gone, CASE WHEN k >= 2 AND rn = 2 THEN '[Folded ' || k || ' repeated lines: ''' || {preview('l')} || ''']' ELSE l END AS l FROM g2 WHERE NOT (k >= 2 AND rn > 2)),
raw AS (SELECT user_id, string_agg(l, chr(10) ORDER BY p) AS t FROM ln GROUP BY user_id),
ag AS (SELECT user_id, string_agg(l, chr(10) ORDER BY p) AS t, sum(gone) + sum(CASE WHEN k >= 2 AND rn = 2 THEN k ELSE 0 END) AS n FROM fi GROUP BY user_id)
SELECT raw.user_id, CASE WHEN length(raw.t) > 100 AND n > 0 THEN ag.t ELSE raw.t END AS text, CAST(CASE WHEN length(raw.t) > 100 THEN n ELSE 0 END AS BIGINT) AS n FROM raw JOIN ag ON raw.user_id = ag.user_id
"""


_CLEAN_Q = _strip(r"lower(regexp_replace('Can you please explain the concept of ' || text || '?', '^[\s\S]*?Question:', ''))")
for _p in fixed.TOPIC_PREFIXES:
    _CLEAN_Q = _strip(f"regexp_replace({_CLEAN_Q}, {_quote(_p)}, '', 'i')")
_CLEAN_Q = _collapse(rf"regexp_replace({_CLEAN_Q}, '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g')")

_CLEAN_EVENT = _strip(r"lower(regexp_replace(question, '^[\s\S]*?Question:', ''))")
for _p in fixed.TOPIC_PREFIXES:
    _CLEAN_EVENT = _strip(f"regexp_replace({_CLEAN_EVENT}, {_quote(_p)}, '', 'i')")
_CLEAN_EVENT = _collapse(rf"regexp_replace({_CLEAN_EVENT}, '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g')")

_NOTE = r"regexp_replace(c.text, '\s+', ' ', 'g') || chr(10) || chr(10) || 'Note: ' || regexp_replace(b.text, '\s+', ' ', 'g') || ' ' || repeat('and so on ', 10)"

_BARE = "'Hi professor! I hope you are doing well. I have an exam tomorrow morning. Could you please tell me ' || text || ' Thanks so much in advance!'"
_SHORT = _strip(f"regexp_replace({_BARE}, {_quote(f'^(?:{fixed.GREETING})+')}, '', 'i')")
for _p in [fixed.PLEASANTRY.removeprefix("(?iU)")]:
    _SHORT = _strip(f"regexp_replace({_SHORT}, {_quote(_p)}, '', 'i')")
for _p in [*fixed.PREAMBLES, fixed.HEDGES]:
    _SHORT = _strip(f"regexp_replace({_SHORT}, {_quote(_p)}, '', 'gi')")
_SHORT = _strip(f"regexp_replace({_SHORT}, {_quote(rf'[,.{chr(92)}s{chr(92)}-—]*(?:{fixed.SIGNOFF}[,.{chr(92)}s!]*)+$')}, '', 'i')")
_SHORT = rf"regexp_replace(regexp_replace(regexp_replace({_SHORT}, '^[,\s.:;\-—]+', ''), '[ \t]+', ' ', 'g'), '[ \t]+([,.?!])', '\1', 'g')"
_SHORT = _strip(rf"regexp_replace({_SHORT}, '\n{{3,}}', chr(10) || chr(10), 'g')")

_SCORE = r"""CASE WHEN length(s) < 10 THEN 0.0 ELSE greatest(0.0,
  CASE WHEN regexp_matches(s, '(?i)\b(?:is defined as|refers to|is the|means that|is a|are a)\b|\b(?:definition|formula|equation|theorem|law|principle|rule)\b') THEN 3.0 ELSE 0.0 END
  + CASE WHEN regexp_matches(s, '[=<>≤≥]+.*[a-zA-Z].*[=<>≤≥+\-*/^]') THEN 4.0 ELSE 0.0 END + len(regexp_extract_all(s, '\*\*[^*]+\*\*')) * 1.5
  + CASE WHEN regexp_matches(s, '^\s*(?:\d+[.):]|[-•*])\s+') THEN 1.5 ELSE 0.0 END + CASE WHEN regexp_matches(s, '\d') THEN 0.5 ELSE 0.0 END
  + CASE WHEN length(s) > 80 THEN 0.5 ELSE 0.0 END - CASE WHEN length(s) < 30 THEN 1.0 ELSE 0.0 END) END"""

_CODE = "'please check' || chr(10) || '```python server.py' || chr(10) || 'def handle(x):' || chr(10) || '" + "' || chr(10) || '".join(f"    step_{k} = load({k})" for k in range(8)) + "' || chr(10) || '    return ' || (turn % 3) || chr(10) || '```'"

ORACLES: dict[str, str] = {
    "code_prune": f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 1 THEN {_CODE} ELSE 'please check' || chr(10) || '[Code Reference: `server.py` is unchanged from previous turn]' END || chr(10) || text AS content, CAST(CASE WHEN k = 1 THEN 0 ELSE 1 END AS BIGINT) AS code_pruned FROM a""",
    "study_package": rf"""
WITH {_LOG}, {_STUDY},
tp AS (SELECT session_id, topic, count(*) AS q, sum(CAST(cache_hit AS INT)) AS h, min(event_seq) AS f FROM ev GROUP BY session_id, topic),
qa AS (SELECT session_id, topic, CASE WHEN contains(question, 'Question:') THEN trim(regexp_replace(question, '^[\s\S]*?Question:', '')) ELSE question END AS question, split_part(answer, '. ', 1) || '.' AS answer,
  row_number() OVER (PARTITION BY session_id, topic ORDER BY event_seq) AS k FROM ev WHERE question <> '' AND answer <> ''),
lines AS (SELECT session_id, topic, string_agg('- **Q**: ' || question || chr(10) || '  **Key Takeaway**: ' || answer || chr(10), '' ORDER BY k) FILTER (WHERE k <= 2) AS md, max(CASE WHEN k = 1 THEN answer END) AS first FROM qa GROUP BY session_id, topic),
j AS (SELECT tp.*, q >= 3 OR h >= 2 AS weak, upper(left(tp.topic, 1)) || substr(tp.topic, 2) AS title, coalesce(md, '') AS md, first FROM tp LEFT JOIN lines ON tp.session_id = lines.session_id AND tp.topic = lines.topic),
g AS (SELECT session_id, string_agg(topic, ',' ORDER BY f) AS topics, string_agg(topic, ', ' ORDER BY f) AS shown, coalesce(string_agg(topic, ',' ORDER BY f) FILTER (WHERE weak), '') AS weak_topics,
  string_agg('### ' || title || chr(10) || md, chr(10) ORDER BY f) FILTER (WHERE weak) AS weak_md, string_agg('- **' || title || '**: ' || first, chr(10) ORDER BY f) FILTER (WHERE NOT weak AND first IS NOT NULL) AS plain_md FROM j GROUP BY session_id),
st AS (SELECT session_id, {_COMMON}{_SESSION_METRICS} FROM log GROUP BY session_id),
cd AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY f, event_seq) AS pos FROM (SELECT session_id, topic, event_seq, min(event_seq) OVER (PARTITION BY session_id, topic) AS f,
  CASE WHEN contains(question, 'Question:') THEN trim(regexp_replace(question, '^[\s\S]*?Question:', '')) ELSE question END AS q, split_part(answer, '. ', 1) || '.' AS a FROM ev WHERE question <> '' AND answer <> '')),
dk AS (SELECT session_id, string_agg(pos || ' | ' || topic || ' | ' || q || ' | ' || a, chr(10) ORDER BY pos) AS cards, string_agg(pos || ' | ' || topic || ' | In ' || topic || ': ' || q || ' | ' || a, chr(10) ORDER BY pos) FILTER (WHERE pos <= 5) AS quiz FROM cd GROUP BY session_id),
ses AS (SELECT session_id FROM log UNION SELECT session_id FROM ev)
SELECT ses.session_id, coalesce(topics, '') AS topics, coalesce(weak_topics, '') AS weak_topics, concat_ws(chr(10), '# 5-Minute Revision Sheet — Session `' || ses.session_id || '`' || chr(10), '**Topics Studied**: ' || coalesce(shown, 'None') || chr(10),
  CASE WHEN weak_md IS NOT NULL THEN '## ⚠️ Areas Needing Reinforcement (Struggling Topics)' || chr(10) || weak_md ELSE '## ✅ Great Job! No persistent struggle patterns detected.' || chr(10) END, '## Quick Reference Summary', plain_md) AS revision_sheet,
  coalesce(requests, 0) AS requests, coalesce(cache_hits, 0) AS cache_hits, coalesce(round_even(cache_hits / requests, 4), 0) AS cache_hit_rate, coalesce(saved_tokens, 0) AS saved_tokens, coalesce(raw_input_tokens, 0) AS raw_input_tokens,
  coalesce(upstream_input_tokens, 0) AS upstream_input_tokens, coalesce(secrets_redacted, 0) AS secrets_redacted, coalesce(pii_redacted, 0) AS pii_redacted, coalesce(secrets_redacted + pii_redacted, 0) AS total_redactions,
  coalesce(cards, '') AS flashcards, coalesce(quiz, '') AS mini_quiz FROM ses LEFT JOIN g ON g.session_id = ses.session_id LEFT JOIN st ON st.session_id = ses.session_id LEFT JOIN dk ON dk.session_id = ses.session_id""",
    "preamble_strip": f"""
WITH a AS (SELECT conv_id, turn, {_BARE} AS raw, {_SHORT} AS t FROM conversations), b AS (SELECT *, CASE WHEN length(t) < 2 THEN raw ELSE t END AS u FROM a),
c AS (SELECT *, CASE WHEN left(u, 1) <> upper(left(u, 1)) THEN upper(left(u, 1)) || substr(u, 2) ELSE u END AS v FROM b)
SELECT conv_id, turn, CASE WHEN length(v) < length(raw) THEN v ELSE raw END AS text, CAST(CASE WHEN length(v) < length(raw) THEN 1 ELSE 0 END AS BIGINT) AS n FROM c""",
    "response_summary": rf"""
WITH {_CONV},
old AS (SELECT *, n >= 3 AND role = 'assistant' AND p < la AND length(text) > 200 AS old FROM conv),
sp AS (SELECT conv_id, p, string_split(regexp_replace({_strip('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM old WHERE old),
se AS (SELECT conv_id, p, {_strip('x')} AS s, i FROM (SELECT conv_id, p, unnest(l) AS x, unnest(range(len(l))) AS i FROM sp)),
sc AS (SELECT conv_id, p, s, i, max(i) OVER (PARTITION BY conv_id, p, s) AS z, {_SCORE} AS score FROM se WHERE s <> ''),
rk AS (SELECT *, row_number() OVER w AS rn, sum(length(s)) OVER (PARTITION BY conv_id, p ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING) AS cum FROM sc WINDOW w AS (PARTITION BY conv_id, p ORDER BY score DESC, i)),
ag AS (SELECT conv_id, p, string_agg(s, ' ' ORDER BY z, i) FILTER (WHERE rn = 1 OR cum <= 200) AS t FROM rk GROUP BY conv_id, p),
fi AS (SELECT o.conv_id, o.p, o.text, CASE WHEN o.old THEN CASE WHEN ag.t IS NULL THEN left(o.text, 200) || '...' ELSE '[AI prior response (~' || len(regexp_extract_all(o.text, '\S+')) || ' words): ' || ag.t || ']' END ELSE o.text END AS content
  FROM old o LEFT JOIN ag ON o.conv_id = ag.conv_id AND o.p = ag.p)
SELECT conv_id, CAST(count(*) FILTER (WHERE content <> text) OVER (PARTITION BY conv_id) AS BIGINT) AS n, CAST(p - 1 AS BIGINT) AS position, content FROM fi""",
    "topic_cluster": f"""
WITH RECURSIVE {_STUDY},
q AS (SELECT session_id, event_seq, {_CLEAN_EVENT} AS c, row_number() OVER (PARTITION BY session_id ORDER BY event_seq) AS k FROM ev),
r(session_id, k, event_seq, seen, topic) AS (
  SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), '' FROM ev
  UNION ALL
  SELECT x.session_id, x.k, x.event_seq, list_append(x.seen, x.t), x.t FROM (
    SELECT y.session_id, y.k, y.event_seq, y.seen, CASE WHEN y.c = '' THEN 'general' WHEN len(y.hits) > 0 THEN y.hits[1] WHEN len(y.own) > 0 THEN array_to_string(y.own[1:3], ' ') ELSE array_to_string(string_split(y.c, ' ')[1:2], ' ') END AS t FROM (
      SELECT r.session_id, q.k, q.event_seq, r.seen, q.c, list_filter(string_split(q.c, ' '), lambda w: length(w) > 1 AND NOT list_contains({_list(fixed.TOPIC_STOP_WORDS)}, w)) AS own,
        list_filter(r.seen, lambda s: contains(q.c, s) OR contains(s, q.c) OR (len(list_filter(string_split(s, ' '), lambda w: NOT list_contains({_list(fixed.TOPIC_STOP_WORDS)}, w))) > 0
          AND list_has_all(string_split(q.c, ' '), list_filter(string_split(s, ' '), lambda w: NOT list_contains({_list(fixed.TOPIC_STOP_WORDS)}, w))))) AS hits
      FROM r JOIN q ON r.session_id = q.session_id AND q.k = r.k + 1) y) x)
SELECT session_id, event_seq, topic FROM r WHERE k > 0""",
    "token_estimate": f"SELECT doc_id, CAST({_tokens('text')} AS BIGINT) AS tokens FROM documents",
    "request_tokens": f"SELECT conv_id, CAST(sum({_tokens('text')} + 4) AS BIGINT) AS tokens, count(*) AS messages FROM conversations GROUP BY conv_id",
    "request_validation": "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id HAVING count(*) <= 6",
    "cache_key_hash": f"SELECT doc_id, sha256({_collapse('lower(text)')}) AS key_hash, left(sha256({_collapse('text')}), 8) AS block_hash FROM documents",
    "cache_query_context": f"""
WITH {_CONV},
pr AS (SELECT conv_id, string_agg(role || ': ' || left({_collapse('text')}, 120), ' | ' ORDER BY p) FILTER (WHERE p < u AND p >= u - 2 AND {_collapse('text')} <> '') AS ctx, max(CASE WHEN p = u THEN text END) AS q FROM conv GROUP BY conv_id)
SELECT conv_id, CASE WHEN coalesce(q, '') = '' THEN '' WHEN ctx IS NULL THEN q ELSE '[Context: ' || ctx || '] Question: ' || q END AS cache_query FROM pr""",
    "code_fingerprint": f"SELECT conv_id, turn, 'see' || chr(10) || '[CodeBlock:py:' || left(sha256({_strip('text')}), 8) || ']' || chr(10) || 'then [CodeBlock::' || left(sha256('x'), 8) || '] end' AS text FROM conversations",
    "hash_embedding_sparse": f"WITH src AS (SELECT conv_id * 1000 + turn AS k, text AS t FROM conversations), {_EMBED} SELECT k AS message_id, idx, w FROM emb",
    "vector_cosine_top1": f"SELECT query_id, entry_id, round(similarity, 6) AS similarity FROM ({_TOP1})",
    "cache_tier_label": f"SELECT query_id, {_tier('similarity', 0.42, 0.36)} AS label FROM ({_TOP1})",
    "exact_cache_lookup": f"WITH d AS (SELECT doc_id, sha256({_collapse('lower(text)')}) AS h FROM documents), e AS (SELECT h, max(doc_id) AS entry_id FROM d WHERE doc_id % 2 = 0 GROUP BY h) SELECT d.doc_id AS query_id, e.entry_id FROM d LEFT JOIN e ON d.h = e.h WHERE d.doc_id % 2 <> 0",
    "exact_cache_replay": f"WITH d AS (SELECT doc_id, sha256({_collapse('lower(text)')}) AS h FROM documents) SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY h) THEN 'MISS' ELSE 'EXACT_HIT' END AS cache, min(doc_id) OVER (PARTITION BY h) AS entry_id FROM d",
    "tiered_resolution": f"WITH {_RESOLVED} SELECT query_id, label, entry_id, round(similarity, 6) AS similarity, rejected FROM res",
    "cache_hit_counts": f"WITH {_RESOLVED} SELECT entry_id, count(*) AS hit_count FROM res WHERE entry_id IS NOT NULL GROUP BY entry_id",
    "guard_counts": f"SELECT doc_id, CAST(secrets AS BIGINT) AS secrets, CAST(mails + phones AS BIGINT) AS pii FROM ({_GUARD})",
    "guard_redact": f"SELECT doc_id, t AS text FROM ({_GUARD})",
    "sentence_dedup": rf"""
WITH s AS (SELECT doc_id, text, {_SENT % 'text'} AS p FROM documents),
x AS (SELECT doc_id, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS i FROM s),
k AS (SELECT *, CASE WHEN length({_strip('s')}) >= 20 THEN {_collapse('lower(s)')} END AS key FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS rn, count(*) OVER (PARTITION BY doc_id, key) AS c FROM k),
a AS (SELECT doc_id, string_agg(CASE WHEN key IS NOT NULL AND c > 1 THEN regexp_replace(s, '\s+$', '') || ' [x' || c || ']' ELSE s END, chr(10) ORDER BY i) FILTER (WHERE key IS NULL OR rn = 1) AS t, count(*) FILTER (WHERE key IS NOT NULL AND rn > 1) AS n FROM r GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN length(s.text) >= 40 AND n > 0 THEN t ELSE s.text END AS text, CAST(CASE WHEN length(s.text) >= 40 THEN n ELSE 0 END AS BIGINT) AS n FROM s JOIN a ON s.doc_id = a.doc_id""",
    "phrase_compact": _phrases(),
    "url_clean": rf"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)\?', 1) AS b, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(url, '^[^#]*(#.*)$', 1) AS f FROM pages),
k AS (SELECT *, array_to_string(list_transform(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT list_contains({_list(fixed.TRACKING)}, lower(split_part(p, '=', 1)))), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') AS n FROM u)
SELECT page_id, CASE WHEN q = '' THEN url ELSE b || CASE WHEN n <> '' THEN '?' || n ELSE '' END || f END AS url FROM k""",
    "structural_normalize": rf"""
WITH t AS (SELECT doc_id, text || chr(10) || '---' || chr(10) || '|  a  | b |' || chr(10) || chr(9) || 'x  y ' || repeat(chr(10), 4) || 'see https://a.example/p?q=1#top' || chr(10) AS t FROM documents),
a AS (SELECT doc_id, replace(t, chr(9), ' ') AS t, 3 AS n FROM t),
b AS (SELECT doc_id, regexp_replace(t, '  +', ' ', 'g') AS t, n + len(regexp_extract_all(t, '  +')) AS n FROM a),
c AS (SELECT doc_id, n, array_to_string(list_transform(string_split(t, chr(10)), lambda l: CASE
  WHEN {_strip('l')} <> '' AND starts_with({_strip('l')}, '|') AND ends_with({_strip('l')}, '|') AND length({_strip('l')}) >= 2 THEN '| ' || array_to_string(list_transform(string_split(substr({_strip('l')}, 2, length({_strip('l')}) - 2), '|'), lambda z: {_strip('z')}), ' | ') || ' |'
  WHEN {_strip('l')} <> '' AND NOT regexp_matches({_strip('l')}, '^([-*+>|]|\d+\.)') THEN {_strip('l')} ELSE regexp_replace(l, '\s+$', '') END), chr(10)) AS t FROM b),
d AS (SELECT doc_id, n + len(regexp_extract_all(t, '\n{{3,}}')) AS n, regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM c)
SELECT doc_id, regexp_replace(t, '^\n+|\n+$', '', 'g') AS text, CAST(n + CASE WHEN regexp_replace(t, '^\n+|\n+$', '', 'g') <> t THEN 1 ELSE 0 END AS BIGINT) AS n FROM d""",
    "binary_describe": "SELECT doc_id, text || ' [sha256 digest] [Embedded base64 data: ~120B image/png] [Base64 data: ~1.2KB]' AS text, CAST(3 AS BIGINT) AS n FROM documents",
    "html_comment_strip": r"SELECT page_id, regexp_replace(html, '<!--[\s\S]*?-->', '', 'g') AS text, CAST(len(regexp_extract_all(html, '<!--[\s\S]*?-->')) AS BIGINT) AS n FROM pages",
    "log_noise_fold": _folded("CASE WHEN event_type = 'error' THEN 'ERROR request failed for ' || event_id ELSE 'INFO user did ' || event_type || ' number ' || event_id END"),
    "log_repeat_fold": _folded("'2024-01-01 00:00:00 WARN queue ' || CASE WHEN event_type IN ('click', 'view') THEN 'slow' ELSE 'stuck' END || ' after ' || event_id || ' ms'"),
    "stack_fold": """
WITH r AS (SELECT l_orderkey, '    at com.shop.Part' || l_partkey || '.load(Part.java:' || l_linenumber || ')' AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
a AS (SELECT l_orderkey, max(n) AS n, 'order ' || l_orderkey || ' stopped' || chr(10) || string_agg(f, chr(10) ORDER BY i) AS raw,
  'order ' || l_orderkey || ' stopped' || chr(10) || string_agg(CASE WHEN i = 3 THEN '    [... ' || (n - 4) || ' more frames ...]' ELSE f END, chr(10) ORDER BY i) FILTER (WHERE i <= 3 OR i > n - 2) AS cut FROM r GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n >= 5 AND length(raw) > 100 THEN cut ELSE raw END AS text, CAST(CASE WHEN n >= 5 AND length(raw) > 100 THEN n - 4 ELSE 0 END AS BIGINT) AS n FROM a""",
    "json_compress": """
WITH r AS (SELECT l_orderkey, l_linenumber AS a, l_partkey AS b, l_returnflag AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS k, '[' || chr(10) || string_agg('  {' || chr(10) || '    "line": ' || a || ',' || chr(10) || '    "part": ' || b || ',' || chr(10) || '    "flag": "' || c || '"' || chr(10) || '  }', ',' || chr(10) ORDER BY i) || chr(10) || ']' AS raw,
  '[' || string_agg('{"line":' || a || ',"part":' || b || ',"flag":"' || c || '"}', ',' ORDER BY i) || ']' AS mini,
  string_agg(a || ' | ' || b || ' | ' || c, chr(10) ORDER BY i) AS tab,
  max(CASE WHEN i = 1 THEN '{"line":' || a || ',"part":' || b || ',"flag":"' || c || '"}' END) AS s0, max(CASE WHEN i = 2 THEN '{"line":' || a || ',"part":' || b || ',"flag":"' || c || '"}' END) AS s1 FROM r GROUP BY l_orderkey),
f AS (SELECT l_orderkey, k, raw, mini, CASE WHEN k >= 5 THEN '[Array of ' || k || ' objects, schema: {flag, line, part}]' || chr(10) || 'Sample[0]: ' || s0 || chr(10) || 'Sample[1]: ' || s1 || chr(10) || '[...' || (k - 2) || ' more items with same structure]' END AS col,
  CASE WHEN k >= 3 THEN '[JSON Table (' || k || ' items): line | part | flag]' || chr(10) || tab END AS tb FROM g),
o AS (SELECT l_orderkey, raw, CASE WHEN length(raw) <= 80 THEN NULL WHEN length(col) < length(raw) * 0.85 THEN col WHEN length(tb) < length(raw) * 0.85 THEN tb WHEN length(mini) < length(raw) * 0.85 THEN mini END AS t FROM f)
SELECT l_orderkey, coalesce(t, raw) AS text, CAST(CASE WHEN t IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n FROM o""",
    "comment_strip": "SELECT conv_id, turn, '```python' || chr(10) || 'value = compute(1)' || chr(10) || 'name = \"# kept\"' || chr(10) || '```' AS text, CAST(1 AS BIGINT) AS n FROM conversations",
    "note_dedup": rf"""
WITH i AS (SELECT count(*) AS items FROM benchmark),
r AS (SELECT c.conv_id, c.turn, {_NOTE} AS content FROM conversations c CROSS JOIN i JOIN benchmark b ON b.item_id = c.conv_id % i.items),
p AS (SELECT conv_id, turn, unnest(regexp_split_to_array(content, '\n\s*\n')) AS para, unnest(range(1, len(regexp_split_to_array(content, '\n\s*\n')) + 1)) AS pos FROM r),
h AS (SELECT conv_id, turn, pos, para, left(sha256({_collapse('para')}), 8) AS h FROM p WHERE length({_strip('para')}) >= 180),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, h ORDER BY turn, pos) AS rn, first_value(left({_collapse('para')}, 100)) OVER (PARTITION BY conv_id, h ORDER BY turn, pos) AS hint FROM h),
n AS (SELECT conv_id, turn, count(*) FILTER (WHERE rn > 1) AS n FROM w GROUP BY conv_id, turn),
z AS (SELECT p.conv_id, p.turn, string_agg(CASE WHEN w.rn > 1 THEN '[Reference: note_' || w.h || ' | Context: "' || w.hint || '..."]' ELSE p.para END, chr(10) || chr(10) ORDER BY p.pos) AS content FROM p LEFT JOIN w ON p.conv_id = w.conv_id AND p.turn = w.turn AND p.pos = w.pos GROUP BY p.conv_id, p.turn)
SELECT z.conv_id, z.turn, z.content, CAST(coalesce(n.n, 0) AS BIGINT) AS notes_deduplicated FROM z LEFT JOIN n ON z.conv_id = n.conv_id AND z.turn = n.turn""",
    "code_outline": "SELECT o_orderkey, 'Classes: [Order' || o_orderkey || '] | Functions: [load, total]' AS outline, 'python_Order' || o_orderkey AS file_key FROM orders",
    "history_filter": f"""
WITH {_CONV},
q AS (SELECT conv_id, {_KEYWORDS % 'text'} AS kw FROM conv WHERE p = u),
j AS (SELECT c.*, q.kw, {_KEYWORDS % 'c.text'} AS tk, '[' || upper(left(c.role, 1)) || lower(substr(c.role, 2)) || ' prior context: ' || {_strip("left(split_part(" + _strip('c.text') + ", chr(10), 1), 60)")} || '...]' AS mark FROM conv c LEFT JOIN q ON c.conv_id = q.conv_id),
o AS (SELECT *, coalesce(n >= 5 AND len(kw) >= 2 AND role <> 'system' AND p <= n - 3 AND length(mark) < length(text) * 0.8 AND
  CASE WHEN len(tk) = 0 THEN 0.0 ELSE len(list_intersect(kw, tk)) / len(list_distinct(list_concat(kw, tk))) END < 0.08, false) AS off FROM j)
SELECT conv_id, CAST(count(*) FILTER (WHERE off) OVER (PARTITION BY conv_id) AS BIGINT) AS n, CAST(p - 1 AS BIGINT) AS position, role, CASE WHEN off THEN mark ELSE text END AS content FROM o""",
    "conversation_shrink": f"WITH {_SHRUNK} SELECT conv_id, mode, CAST(raw AS BIGINT) AS raw_tokens, CAST(optimized AS BIGINT) AS optimized_tokens, CAST(shrunk AS BIGINT) AS turns_shrunk, CAST(kept AS BIGINT) AS turns_kept, CAST(messages AS BIGINT) AS messages, CASE WHEN made IS NOT NULL THEN 'system' ELSE r1 END AS first_role, coalesce(made, t1) AS first_content FROM shr",
    "no_inflation_guard": f"WITH {_SHRUNK} SELECT conv_id, optimized > raw AS reverted, CAST(CASE WHEN optimized > raw THEN 0 ELSE raw - optimized END AS BIGINT) AS saved_tokens FROM shr",
    "budget_mode": f"""
WITH {_LOG}, a AS (SELECT request_seq, output_tokens, raw_input_tokens * 3 AS raw, CASE request_seq % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'saving' WHEN 2 THEN 'normal' ELSE budget_mode END AS m FROM log),
b AS (SELECT *, CASE WHEN raw >= 4000 THEN 'critical' WHEN raw >= 2000 AND m = 'normal' THEN 'saving' ELSE m END AS mode FROM a)
SELECT request_seq, mode, {_cap('mode')} AS cap, CAST(CASE WHEN mode = 'normal' THEN 0 ELSE greatest(0, 700 - output_tokens) END AS BIGINT) AS saved_default, CAST(CASE WHEN mode = 'normal' THEN 0 ELSE greatest(0, 250 - output_tokens) END AS BIGINT) AS saved_measured, CAST(length({_DIRECTIVE}) AS BIGINT) AS directive_chars FROM b""",
    "provider_waterfall": """
WITH s AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN [] ELSE [CASE WHEN event_id % 3 = 0 THEN 429 WHEN event_id % 7 = 0 THEN 400 ELSE 200 END, CASE WHEN event_id % 5 = 0 THEN 503 ELSE 200 END, CASE WHEN event_id % 2 = 0 THEN 500 ELSE 200 END] END AS st FROM events),
p AS (SELECT *, coalesce(list_position(list_transform(st, lambda x: x NOT IN (402, 403, 408, 409, 425, 429, 500, 502, 503, 504)), true), 0) AS k FROM s)
SELECT event_id, CASE WHEN len(st) = 0 THEN 'none' WHEN k > 0 THEN ['a', 'b', 'c'][k] ELSE 'all' END AS provider, CAST(CASE WHEN len(st) = 0 THEN 401 WHEN k > 0 THEN st[k] ELSE 502 END AS INT) AS status,
  coalesce(k > 1 AND st[k] = 200, false) AS used_failover, CAST(CASE WHEN k > 0 THEN k ELSE len(st) END AS INT) AS tried FROM p""",
    "live_metrics": f"WITH {_LOG}, a AS (SELECT {_COMMON}{_METRICS} FROM log) SELECT *, {_RATES} FROM a",
    "budget_breakdown": f"WITH {_LOG} SELECT budget_mode, count(*) AS requests FROM log GROUP BY budget_mode",
    "top_strategies": f"WITH {_LOG}, x AS (SELECT request_seq, unnest(string_split(strategies, ',')) AS strategy, unnest(range(len(string_split(strategies, ',')))) AS k FROM log), g AS (SELECT strategy, count(*) AS uses, min(request_seq * 100 + k) AS f FROM x GROUP BY strategy) SELECT strategy, uses, row_number() OVER (ORDER BY uses DESC, f) AS rank FROM g",
    "quota_forecast": f"""
WITH {_LOG}, t AS (SELECT count(*) AS r, sum(upstream_input_tokens) + sum(output_tokens) AS used FROM log),
a AS (SELECT r, used, greatest(0, 5000000000 - used) AS left_, used / r AS av FROM t), b AS (SELECT *, greatest(100, CAST(trunc(av * 10) AS BIGINT)) AS burn, CAST(trunc(left_ / av) AS BIGINT) AS q FROM a)
SELECT CAST(5000000000 AS BIGINT) AS daily_token_quota, CAST(used AS BIGINT) AS used_tokens, CAST(left_ AS BIGINT) AS remaining_quota, q AS estimated_questions_left, CAST(trunc(used * 1.4) AS BIGINT) AS projected_daily_tokens,
  CASE WHEN used > 5000000000 * 0.6 OR q < 20 THEN 'critical' ELSE 'saving' END AS budget_mode_recommendation, round(left_ / burn, 1) AS runway_hours, round(left_ / (CAST(burn AS DOUBLE) * 0.45), 1) AS runway_critical_hours FROM b""",
    "output_baseline": f"WITH {_LOG}, a AS (SELECT count(*) AS samples, CAST(round(avg(output_tokens)) AS BIGINT) AS m FROM log WHERE budget_mode = 'normal' AND NOT cache_hit AND output_tokens > 0) SELECT CASE WHEN samples >= 5 AND m > 0 THEN m END AS baseline, CASE WHEN samples >= 5 AND m > 0 THEN 'measured_avg' ELSE 'default_baseline' END AS basis, samples FROM a",
    "session_stats": f"WITH {_LOG}, a AS (SELECT session_id, {_COMMON}{_SESSION_METRICS} FROM log GROUP BY session_id) SELECT *, {_RATES} FROM a",
    "session_timeline": f"""
WITH {_LOG} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY request_seq) AS position, request_id,
  CASE WHEN coalesce(cache, 'MISS') <> 'MISS' THEN cache WHEN NOT cache_hit THEN 'MISS' WHEN contains(strategies, 'exact_cache') THEN 'EXACT_HIT' ELSE 'HIT' END AS cache,
  provider, model, raw_input_tokens, optimized_input_tokens, saved_tokens AS saved_input_tokens, strategies, secrets_redacted, pii_redacted, guard_mode, budget_mode, CAST(code_pruned AS BIGINT) AS code_pruned FROM log""",
    "receipt_lookup": f"WITH {_RECEIPT} SELECT request_id, request_seq, topic, budget_mode, max_output_tokens, estimated_output_tokens_saved FROM rc",
    "recommendations": f"""
WITH {_RECEIPT}, x AS (SELECT *, coalesce(cache, 'MISS') AS ca FROM rc), t AS (
  SELECT request_id, 1 AS o, 'cache' AS type, 'Zero Upstream Token Cost' AS title, 'This response was fulfilled instantly from ' || CASE WHEN ca = 'EXACT_HIT' THEN 'exact cache' ELSE 'semantic cache' END || ' with 0 upstream API tokens billed.' AS message, 'Explore Similar Questions' AS action FROM x WHERE ca <> 'MISS'
  UNION ALL SELECT request_id, 2, 'output_budget', 'Use Hint / Critical Mode', 'This answer used ' || output_tokens || ' output tokens. Critical/Hint Mode caps output to 120 tokens (~60% savings).', 'Switch to Critical Mode' FROM x WHERE output_tokens > 250 OR budget_mode = 'normal'
  UNION ALL SELECT request_id, 2, 'output_budget', 'Critical Hint Mode Active', 'Critical mode capped this output to ' || output_tokens || ' tokens (saved ~' || estimated_output_tokens_saved || ' tokens vs normal baseline).', 'Maintain Critical Budget' FROM x WHERE output_tokens <= 250 AND budget_mode = 'critical'
  UNION ALL SELECT request_id, 4, 'notes', 'Repeated Notes Compressed', notes_deduplicated || ' repetitive note blocks in your session were replaced with compact reference tags.', 'Reuse Note Tags' FROM x WHERE notes_deduplicated > 0
  UNION ALL SELECT request_id, 5, 'code', 'Code Diff Pruning Active', 'Your updated code was sent upstream as a compact AST diff against your previous turn instead of resending the full file.', 'Continue Iterating' FROM x WHERE code_pruned > 0
  UNION ALL SELECT request_id, 6, 'failover', 'Provider Shield Active', 'Primary provider hit rate limits or downtime; the gateway seamlessly routed your query to ' || provider || '.', 'Check Provider Status' FROM x WHERE failover_used
  UNION ALL SELECT request_id, 7, 'logs', 'Terminal Noise Folded', logs_folded || ' repetitive log lines were folded, keeping error traces 100% intact.', 'Keep Pasting Logs' FROM x WHERE logs_folded > 0
  UNION ALL SELECT request_id, 8, 'json', 'JSON Losslessly Compacted', json_compressed || ' JSON blocks were stripped of indentation waste with zero data loss.', 'Send Raw JSON' FROM x WHERE json_compressed > 0
  UNION ALL SELECT request_id, 9, 'prompt', 'Shorter Prompt Tip', 'Large prompt with low compression. Try asking: ''Explain in 5 bullets with 1 example'' or uploading reference notes once.', 'Apply Prompt Tip' FROM x WHERE raw_input_tokens > 800 AND saved_tokens < raw_input_tokens * 0.2 AND ca = 'MISS')
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY o) - 1 AS position, type, title, message, action FROM t""",
    "session_study_events": f"WITH {_STUDY} SELECT session_id, event_seq, topic, cache_hit FROM ev",
    "session_topics": f"WITH {_STUDY}, a AS (SELECT session_id, topic, min(event_seq) AS f FROM ev GROUP BY session_id, topic) SELECT session_id, topic, row_number() OVER (PARTITION BY session_id ORDER BY f) AS position FROM a",
    "latest_code_snapshot": "SELECT CAST(l_suppkey AS VARCHAR) AS session_id, 'file' || l_linenumber AS file_key, 'x = ' || arg_max(l_partkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) AS code FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "topic_extract": f"""
WITH c AS (SELECT conv_id, turn, {_CLEAN_Q} AS c FROM conversations), w AS (SELECT *, list_filter(string_split(c, ' '), lambda x: length(x) > 1 AND NOT list_contains({_list(fixed.TOPIC_STOP_WORDS)}, x)) AS own FROM c)
SELECT conv_id, turn, CASE WHEN c = '' THEN 'general' WHEN len(own) > 0 THEN array_to_string(own[1:3], ' ') ELSE array_to_string(string_split(c, ' ')[1:2], ' ') END AS topic FROM w""",
    "struggle": f"""
WITH {_STUDY}, a AS (SELECT *, count(*) OVER w AS before, coalesce(sum(CAST(cache_hit AS INT)) OVER w, 0) AS hits FROM ev WINDOW w AS (PARTITION BY session_id, lower(topic) ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, event_seq, topic, before + 1 AS repeat_count, before + 1 >= 3 OR hits >= 2 AS struggling FROM a""",
    "study_package_topics": f"WITH {_STUDY}, a AS (SELECT session_id, topic, count(*) AS questions, CAST(sum(CAST(cache_hit AS INT)) AS BIGINT) AS cache_hits, min(event_seq) AS f FROM ev GROUP BY session_id, topic) SELECT session_id, topic, row_number() OVER (PARTITION BY session_id ORDER BY f) AS position, questions, cache_hits, questions >= 3 OR cache_hits >= 2 AS weak FROM a",
    "flashcards": rf"""
WITH {_STUDY}, a AS (SELECT *, min(event_seq) OVER (PARTITION BY session_id, topic) AS f FROM ev WHERE question <> '' AND answer <> ''), b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY f, event_seq) AS position FROM a)
SELECT session_id, position, topic, CASE WHEN contains(question, 'Question:') THEN trim(regexp_replace(question, '^[\s\S]*?Question:', '')) ELSE question END AS question, split_part(answer, '. ', 1) || '.' AS answer, CASE WHEN position <= 5 THEN position END AS quiz_id,
  CASE WHEN position <= 5 THEN 'In ' || topic || ': ' || CASE WHEN contains(question, 'Question:') THEN trim(regexp_replace(question, '^[\s\S]*?Question:', '')) ELSE question END END AS quiz_question FROM b""",
    "verifier_usage": """
SELECT event_id, CAST(CASE WHEN event_id % 3 = 1 AND event_id % 100 <> 0 THEN event_id % 100 ELSE CASE WHEN event_id % 2 = 0 THEN event_id % 50 ELSE 0 END + 4 END AS BIGINT) AS tokens_used,
  CASE event_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'unavailable' END AS verdict FROM events""",
}
ORACLES |= cases.ORACLES
ORACLES["finish_session"] = f"""
SELECT session_id, topics, requests, cache_hits, raw_input_tokens, upstream_input_tokens, CAST(len(string_split(flashcards, chr(10))) AS INT) AS cards, CAST(len(string_split(mini_quiz, chr(10))) AS INT) AS quiz
FROM ({ORACLES["study_package"]}) WHERE session_id = 's1'"""
