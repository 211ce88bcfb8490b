"""Literal inputs of the text operators."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import comments, pyops, text


def run(spark, op, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, c string").withColumn("o", op(F.col("c"))).orderBy("k").collect()
    return [r.o for r in rows]


def test_guard_numbers_from_the_right(spark):
    key = "sk-" + "a1B2" * 6
    got = run(spark, text.redact, f"mail a@b.example and c@d.example, call +1 555-123-4567, {key}", None, "")[0]
    assert got.text == "mail [REDACTED_EMAIL_2] and [REDACTED_EMAIL_1], call [REDACTED_PHONE_1], [REDACTED_SECRET_1]"
    assert (got.secrets, got.emails, got.phones) == (1, 2, 1)


def test_guard_keeps_key_names(spark):
    got = run(spark, text.redact, "api_key = '" + "x" * 20 + "' and token: " + "y" * 20)[0]
    assert got.text == "api_key = '[REDACTED_SECRET_2]' and token: [REDACTED_SECRET_1]"


def test_sentences(spark):
    s = "A derivative is the rate of change."
    one, short, code, null = run(spark, text.dedup_sentences, f"{s} {s} {s}", "I see. I see. I see. I see. I see. I see.", f"{s}\n```py\n{s}\n{s}\n```\n{s} {s}", None)
    assert (one.text, one.n) == (f"{s} [x3]", 2)
    assert short.n == 0 and code.n == 1 and f"```py\n{s}\n{s}\n```" in code.text and null.text is None


def test_preamble(spark):
    got = run(spark, text.strip_preamble, "Hi professor! Hope you are doing well. I have an exam tomorrow morning and I am really confused about one concept. Could you please explain what is database normalization? Thanks in advance!", "Basically what is `sort of` a tree", "short")
    assert got[0].n == 1 and "database normalization" in got[0].text and len(got[0].text) < 80
    assert "`sort of`" in got[1].text and got[2].n == 0


@pytest.mark.parametrize("c", ["." * 4000, "thanks, " * 2000, "a " * 150_000, "`" * 3000])
def test_preamble_is_not_exponential(spark, c):
    assert run(spark, text.strip_preamble, "what is it " + c)[0] is not None


def test_phrases(spark):
    got = run(spark, text.compact_phrases, "We did it in order to learn, due to the fact that it matters.", "```\nin order to keep this as it is\n```\nas it was")
    assert got[0].text == "We did it to learn, because it matters." and got[0].n == 2 and got[1].n == 0


def test_structure(spark):
    got = run(spark, text.normalize_structure, "see https://a.example/x?utm_source=q&id=1#t now\n|  a   |  b  |\n=========\n\n\n\n\ttext  here\n```\na\t\tb\n```")[0]
    assert got.text == "see https://a.example/x?id=1#t now\n| a | b |\n---\n\ntext here```\na\t\tb\n```" and got.n == 10  # link, delimiter, tab, five runs of blanks, line feeds within and at the end


def test_binary(spark):
    hexes = "\n".join(" ".join(["4A"] * 16) for _ in range(5))
    uri, dump, fenced = run(spark, text.describe_binary, "data:image/png;base64," + "A" * 200 + " end", f"dump follows here\n{hexes}\nend of the dump", "```\n" + "ab" * 64 + "\n```")
    assert uri.text == "[Embedded base64 data: ~150B image/png] end" and uri.n == 1
    assert dump.text.endswith("[Hex dump: 80 bytes]") and dump.n == 1 and fenced.n == 0


def test_long_dump_lines(spark):
    line = " ".join(["0x4A"] * 100_000)
    got, = run(spark, text.describe_binary, f"{line}\n{line} end")
    assert got.text == "end\n[Hex dump: 200000 bytes]" and got.n == 1


def test_logs():
    noise = [f"INFO step {k}" for k in range(10)]
    out, n = pyops.fold_logs("\n".join([*noise, "ERROR: build failed", *noise[:5]]))
    assert n == 15 and "ERROR: build failed" in out and "[Folded 10 " in out and "[Folded 5 " in out


def test_traces():
    frames = [x for k in range(7) for x in (f'  File "a{k}.py", line {k}, in f', f"    call({k})")]
    out, n = pyops.fold_logs("\n".join(["Traceback (most recent call last):", *frames, "ValueError: x"]))
    assert n == 6 and "[... 3 more frames ...]" in out and out.endswith("ValueError: x")
    java = [f"  at com.a.B.m{k}(B.java:{k})" for k in range(15)]
    assert pyops.fold_logs("\n".join(["Oops", *java]))[1] == 11


def test_json():
    import json

    rows = [{"id": k, "name": f"course {k}", "tags": [1]} for k in range(7)]
    out, n = pyops.compress_json("```json\n" + json.dumps(rows, indent=4) + "\n```")
    assert n == 1 and "[...5 more items with same structure]" in out
    flat = [{"id": k, "a": None, "b": True} for k in range(4)]
    out, n = pyops.compress_json(json.dumps(flat, indent=4))
    assert out.startswith("[JSON Table (4 items): id | a | b]\n0 | None | True") and n == 1
    assert pyops.compress_json("[1,2]")[1] == 0 and pyops.compress_json("{broken")[1] == 0


@pytest.mark.parametrize(("lang", "code", "gone", "kept"), [
    ("python", "#!/bin/x\nx = '# no'  # yes it goes\n# whole line\ny = 1  # noqa", ["yes it goes", "whole line"], ["#!/bin/x", "'# no'"]),
    ("js", "const a = 'http://x'; // gone\n/* block\nmore */\nlet b = \"/* no */\";", ["gone", "block"], ["'http://x'", "/* no */"]),
    ("sql", "SELECT 1 -- gone\n-- all gone\nFROM t WHERE a = '--no'", ["gone"], ["'--no'"]),
    ("html", "<p>x</p><!-- gone --><!--[if IE]>kept<![endif]-->", ["gone"], ["[if IE]"]),
    ("css", "a { b: c; } /* gone, all of it, really */", ["gone"], ["b: c"]),
])
def test_comments(lang, code, gone, kept):
    out = comments.strip_code(code, lang)
    assert not any(x in out for x in gone) and all(x in out for x in kept)


@pytest.mark.parametrize(("before", "after"), [
    ('def f(x):\n    """Adds one.\n\n    Longer.\n    """\n    return x', 'def f(x):\n    """Adds one."""\n    return x'),
    ('def f(x):\n    """One line."""\n    return x', 'def f(x):\n    """One line."""\n    return x'),
    ("class A(B):\n    '''\n    Said\n    more\n    '''\n    y = 1", "class A(B):\n    '''Said.'''\n    y = 1"),
])
def test_docstrings(before, after):
    assert comments.strip_code(before, "py") == after


@pytest.mark.parametrize(("before", "after"), [
    ("/**\n * Adds two.\n * @param x one\n */\nint f;", "int f;"), ("/** one line */\nint f;", "/** one line */\nint f;"), ("/**\n * @return x\n */\nint f;", "int f;"),
    ("int a; // x\nchar *b = \"// no\"; /* c */", 'int a;\nchar *b = "// no"; '),
])
def test_block_comments(before, after):
    assert comments.strip_code(before, "java") == after.rstrip("\n")
    assert comments.jsdocs("/**\n * " + "w" * 70 + "\n * @x\n */") == "/* " + "w" * 57 + "... */"


@pytest.mark.parametrize(("before", "after"), [
    ("# Heading\ntext", "# Heading\ntext"), ("# TODO later\ntext", "text"), ("def f(x):\n    return x  # one\n# two\n### three", "def f(x):\n    return x"),
    ("SELECT a FROM t -- all\n-- none", "SELECT a FROM t"), ("a -- b", "a -- b"), ("x // gone\nsee https://a.b // kept", "x\nsee https://a.b // kept"), ("#!/bin/sh\n# noqa\n#include", "#!/bin/sh\n# noqa"),
    ("a <!-- b --> c /* d */", "a  c"), ("    # Deep\nx", "x"),
])
def test_loose_comments(before, after):
    assert comments.strip_loose(before) == after


def test_traces_of_every_shape():
    frame = lambda k: [f'  File "a{k}.py", line {k}, in f', f"    call({k})"]
    head = "Traceback (most recent call last):"
    few = [head, *frame(1), *frame(2), "KeyError: 1"]
    assert pyops.fold_traces(few) == (few, 0)
    many = [x for k in range(9) for x in frame(k)]
    out, n = pyops.fold_traces(["a", head, *many, "KeyError: 1", "", *many, "b"])
    assert n == 10 and out == ["a", head, *many[:4], "    [... 5 more frames ...]", *many[-4:], "KeyError: 1", "", *many, "b"]
    node = [f"    at f{k} (a.js:{k}:1)" for k in range(6)] + ["  ... 12 more"]
    assert pyops.fold_traces(["E", *node, "x"]) == (["E", *node[:2], "    [... 3 more frames ...]", *node[-2:], "x"], 3)


def test_nulls_pass(spark):
    for op in (text.dedup_sentences, text.strip_preamble, text.compact_phrases, text.normalize_structure, text.describe_binary, pyops.fold_logs_column, pyops.compress_json_column, comments.strip_comments_column):
        got = run(spark, op, None, "")
        assert got[0].text is None and got[1].text == ""
