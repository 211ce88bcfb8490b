"""Comments taken out of code. Languages are rows of a table of steps; a step on lines is a list of (test, action) rules, of
which the first that holds decides; strings are found by scanners that step from token to token."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.pyops import guarded

# Languages by the style of their comments.
PYTHON = frozenset(("python", "py"))
HASH = PYTHON | frozenset("ruby rb perl pl bash sh zsh r yaml yml toml dockerfile makefile make powershell ps1".split())
SLASH = frozenset("javascript js typescript ts java c cpp c++ csharp cs go rust rs kotlin kt swift scala dart php".split())
DASH = frozenset("sql pgsql postgres postgresql mysql sqlite sqlite3 plsql tsql haskell hs lua ada".split())
STYLE = frozenset("css scss less sass".split())
MARKUP = frozenset("html xml svg vue jsx tsx markdown md".split())
# Patterns of code, of comments that stay, and of headings; the shortest code that is looked at.
DIRECTIVE = re.compile(r"#\s*(type:\s*ignore|noqa|pragma|pylint|mypy|pyright)")
DIRECTIVE_LOOSE = re.compile(r"#\s*(type:\s*ignore|noqa|pragma|pylint)")
DOCSTRING = re.compile(r"((?:def\s+\w+\s*\([^)]*\)\s*(?:->\s*[^:]+)?|class\s+\w+(?:\([^)]*\))?)\s*:\s*\n\s*)(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')\s*\n", re.M)
JSDOC = re.compile(r"/\*\*([\s\S]*?)\*/")
HTML = re.compile(r"<!--(?!\[if\s)[\s\S]*?-->")
SQL_CODE = re.compile(r"\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|CREATE\s+TABLE)\b", re.I)
PY_CODE = re.compile(r"\b(def\s+\w+|class\s+\w+|import\s+\w+|elif\s+|if\s+__name__|return\b)")
URL = re.compile(r"https?://")
HEADING = re.compile(r"###|##|# ")
META = re.compile(r"(?i)#\s*(Author|Date|License|TODO|FIXME|NOTE|Step\s*\d|Base|Recursive|Check|Config)")
FENCED = re.compile(r"```([^\n`]*)\n([\s\S]*?)```")
LEAST, TITLE = 30, 60

_TRIPLE = re.compile(r"\"\"\"|'''")
_HASH_TOKEN = re.compile(r"\"\"\"|'''|\\.|[\"'#]", re.S)
_QUOTED = {"//": re.compile(r"\\.|[\"'`]|//", re.S), "--": re.compile(r"\\.|[\"']|--", re.S)}
_BLOCK_TOKEN = re.compile(r"\\.|[\"']|/\*", re.S)
#: A line of a block comment that says something: its stars go, and tags don't count.
_SAID = re.compile(r"^[^\S\n]*+\**+[^\S\n]*+(?!@)(\S.*?)[^\S\n]*$", re.M)


def cut_hash(line: str) -> str:
    """The line up to a # outside strings. Triple quotes open and close whatever other quote is open but their own kind's."""
    quote = triple = ""
    at = 0
    while m := (_TRIPLE if triple else _HASH_TOKEN).search(line, at):
        at, token = m.end(), m[0]
        if len(token) == 3:
            if triple:
                triple = "" if token == triple else triple
            elif not quote or quote == token[0]:
                triple = token
        elif token[0] == "\\":
            continue
        elif token == "#":
            if not quote:
                return line[: m.start()].rstrip()
        elif not quote:
            quote = token
        elif quote == token:
            quote = ""
    return line


def cut_quoted(line: str, marker: str) -> str:
    """The line up to // or -- outside strings; what a backslash escapes counts only inside them."""
    quote, at = "", 0
    while m := _QUOTED[marker].search(line, at):
        at, token = m.end(), m[0]
        if token[0] == "\\":
            at = m.end() if quote else m.start() + 1
        elif token == marker:
            if quote:
                at = m.start() + 1
            elif marker == "//" and m.start() >= 5 and line[m.start() - 5 : m.start() + 2].lower() == "http://":
                continue
            else:
                return line[: m.start()].rstrip()
        elif not quote:
            quote = token
        elif quote == token:
            quote = ""
    return line


def drop_blocks(code: str) -> str:
    """Without /* */ outside strings; a /** */ on one line stays."""
    out: list[str] = []
    quote, at = "", 0
    begin = 0
    while m := _BLOCK_TOKEN.search(code, at):
        at, token = m.end(), m[0]
        if token[0] == "\\":
            at = m.end() if quote else m.start() + 1
        elif token == "/*":
            if quote:
                at = m.start() + 1
                continue
            doc = code[m.end() : m.end() + 1] == "*" and code[m.end() + 1 : m.end() + 2] != "/"
            if doc and (end := code.find("*/", m.end() + 1)) >= 0 and "\n" not in code[m.start() : end]:
                at = end + 2
            elif (end := code.find("*/", m.end())) >= 0:
                out.append(code[begin : m.start()])
                begin = at = end + 2
            else:
                at = m.start() + 1
        elif not quote:
            quote = token
        elif quote == token:
            quote = ""
    return "".join([*out, code[begin:]])


def docstrings(code: str) -> str:
    """Docstrings of several lines become their first one; those that start with an empty line go."""
    def short(m: re.Match) -> str:
        title, several, _ = m[2][3:-3].strip().partition("\n")
        if not several:
            return m[0]
        said, quotes = title.strip().rstrip("."), m[2][:3]
        return m[1] + (f"{quotes}{said}.{quotes}\n" if said else "")

    return DOCSTRING.sub(short, code)


def jsdocs(code: str) -> str:
    """Block comments of several lines become the first that says something, TITLE characters at most, or go."""
    def short(m: re.Match) -> str:
        if "\n" not in m[1].strip():
            return m[0]
        said = _SAID.search(m[1])
        return "" if said is None else f"/* {said[1] if len(said[1]) <= TITLE else said[1][: TITLE - 3] + '...'} */"

    return JSDOC.sub(short, code)


Rule = tuple[Callable[[str], object], Callable[[str], str] | None]
KEEP, DROP, ALWAYS = str, None, lambda line: True


def each_line(code: str, rules: Sequence[Rule]) -> str:
    """Each line as the first rule whose test holds says; None drops it. Lines that no rule is for stay."""
    done = ((line, next((act for test, act in rules if test(line)), KEEP)) for line in code.split("\n"))
    return "\n".join(act(line) for line, act in done if act is not DROP)


def starts(mark: str) -> Callable[[str], bool]:
    return lambda line: line.lstrip().startswith(mark)


def holds(pattern: re.Pattern) -> Callable[[str], object]:
    return lambda line: pattern.search(line.lstrip())


LINES: dict[str, list[Rule]] = {
    "#": [(starts("#!"), KEEP), (holds(DIRECTIVE), KEEP), (starts("#"), DROP), (ALWAYS, cut_hash)],
    "//": [(starts("//"), DROP), (ALWAYS, partial(cut_quoted, marker="//"))],
    "--": [(starts("--"), DROP), (ALWAYS, partial(cut_quoted, marker="--"))],
}
#: What is done to code, in this order, if its language is one of these.
STEPS: list[tuple[frozenset[str], Callable[[str], str]]] = [
    (HASH, partial(each_line, rules=LINES["#"])),
    (PYTHON, docstrings),
    (SLASH, jsdocs),
    (SLASH, partial(each_line, rules=LINES["//"])),
    (DASH, partial(each_line, rules=LINES["--"])),
    (SLASH | DASH | STYLE, drop_blocks),
    (MARKUP, partial(HTML.sub, "")),
]


def strip_code(code: str, lang: str) -> str:
    """Code without the comments of its language."""
    done = reduce(lambda text, step: step[1](text) if lang in step[0] else text, STEPS, code)
    return re.sub(r"\n{3,}", "\n\n", done).strip("\n")


def _loose_rules(sql: bool, py: bool) -> list[Rule]:
    """Rules for the lines of a text that looks like SQL, like Python, both or neither."""
    indented = lambda line: line.startswith(("    ", "\t"))
    heading = lambda line: HEADING.match(line.lstrip()) and not (py or indented(line) or META.match(line.lstrip()))
    cuts: list[Callable[[str], str]] = []
    if sql:
        cuts.append(partial(cut_quoted, marker="--"))
    cuts.append(lambda line: line if URL.search(line) else cut_quoted(line, "//"))
    if py:
        cuts.append(cut_hash)
    comment = starts("#")
    return [
        (starts("//"), DROP),
        (lambda line: sql and starts("--")(line), DROP),
        (lambda line: comment(line) and (starts("#!")(line) or holds(DIRECTIVE_LOOSE)(line) or heading(line)), KEEP),
        (comment, DROP),
        (ALWAYS, lambda line: reduce(lambda x, cut: cut(x), cuts, line)),
    ]


def strip_loose(text: str) -> str:
    """Text with comments of pasted code removed, headings kept unless it looks like Python."""
    if not re.search(r"/\*|<!--|//|--|#|\"\"\"|'''", text):
        return text
    text = HTML.sub("", drop_blocks(jsdocs(text)))
    text = docstrings(text) if re.search("def |class ", text) else text
    text = each_line(text, _loose_rules(bool(SQL_CODE.search(text)), bool(PY_CODE.search(text))))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def strip_comments(text: str) -> tuple[str, int]:
    """Fenced code by its language, then all that is left as loose text."""
    n = 0

    def fence(m: re.Match) -> str:
        nonlocal n
        lang = next(iter(m[1].lower().split()), "")
        clean = strip_code(m[2], lang) if lang and len(m[2].strip()) >= LEAST else ""
        if not clean.strip() or clean == m[2].strip("\n"):
            return m[0]
        n += 1
        return f"```{m[1]}\n{clean}\n```"

    text = FENCED.sub(fence, text)
    loose = strip_loose(text)
    changed = bool(loose.strip()) and loose not in (text, text.strip())
    return (loose, n + 1) if changed else (text, n)


def strip_comments_column(text: Column) -> Column:
    return guarded(text, (F.length(text) > LEAST) & text.rlike(r"/\*|<!--|//|--|#|\"\"\"|'''|```"), strip_comments)
