"""What a block of code is called and what it defines. Names are found by column expressions; only a syntax tree is Python."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.core import collapse, let

# Patterns of file names and of definitions; characters before a block, and of its head, that are looked at.
FILE_COMMENT = r"(?iU)(?:#|//|<!--|\*)\s*(?:filename|file):\s*([a-zA-Z0-9_.-]+)"
FILE_FIRST = r"(?mdU)^(?:#|//)\s*([a-zA-Z0-9_.-]+\.[a-zA-Z0-9]+)\s*$"
FILE_NAMED = r"(?U)\b([a-zA-Z0-9_.-]+\.[a-zA-Z0-9]{1,8})\b"
SIGNED = r"(?iU)(?:class|interface|struct|function|func|def)\s+([a-zA-Z0-9_]+)"
BEFORE, HEAD = 150, 200

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tree(code: str) -> ast.Module | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def outline(code: str) -> str:
    """Names of a Python text's classes and functions; empty if it isn't Python."""
    tree = _tree(code)
    kinds = {"Classes": ast.ClassDef, "Functions": _FUNCTION} if tree else {}
    named = {k: sorted({x.name for x in ast.walk(tree) if isinstance(x, t)}) for k, t in kinds.items()}
    return " | ".join(f"{k}: [{', '.join(v)}]" for k, v in named.items() if v)


def _first_defined(code: str) -> str | None:
    tree = _tree(code)
    return next((x.name for x in tree.body if isinstance(x, (ast.ClassDef, *_FUNCTION))), None) if tree else None


@F.pandas_udf(T.StringType())
def outline_column(code: pd.Series) -> pd.Series:
    return code.map(lambda x: None if x is None else outline(x))


@F.pandas_udf(T.StringType())
def first_defined_column(code: pd.Series) -> pd.Series:
    return code.map(lambda x: None if x is None else _first_defined(x))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def file_key(info: Column, code: Column, before: Column) -> Column:
    """What a code block is called: the first of a file name in its fence, in a comment, on its first lines, or last in the text
    before it; else its language with the first thing that it defines. Only blocks without a file name go to the parser."""
    info, code, before = (F.coalesce(c, F.lit("")) for c in (info, code, before))
    is_file = lambda w: w.contains(".") & ~w.endswith(".")
    words = F.split(collapse(info), " ")
    named = F.coalesce(
        F.get(F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), is_file), F.lit(0)),
        _found(code, FILE_COMMENT),
        _found(F.left(code, F.lit(HEAD)), FILE_FIRST),
        F.try_element_at(F.filter(F.regexp_extract_all(F.right(before, F.lit(BEFORE)), F.lit(FILE_NAMED), F.lit(1)), lambda w: ~w.endswith(".")), F.lit(-1)),
    )
    defined = F.coalesce(first_defined_column(F.when(named.isNull(), code)), _found(code, SIGNED), F.lit("snippet"))
    lang = F.coalesce(F.nullif(F.lower(F.get(words, F.lit(0))), F.lit("")), F.lit("code"))
    return F.coalesce(named, F.concat_ws("_", lang, defined))


def blocks(text: Column, fence: str) -> Column:
    """array<struct<at, block, info, code, before>> of the fenced blocks of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(fence), F.lit(0))
    rest = F.split(text, fence, -1)

    def of(block: Column, i: Column, found: Column, rest: Column) -> Column:
        so_far = F.concat(F.array_join(F.zip_with(F.slice(rest, F.lit(1), i), F.slice(found, F.lit(1), i), lambda a, b: F.concat(a, b)), ""), F.get(rest, i))
        info = F.substring_index(F.substring(block, F.lit(4), F.length(block)), "\n", 1)
        code = F.substring(block, F.length(info) + 5, F.length(block) - F.length(info) - 7)
        return F.struct(i.alias("at"), block.alias("block"), info.alias("info"), code.alias("code"), F.right(so_far, F.lit(BEFORE)).alias("before"))

    return let(F.struct(found.alias("f"), rest.alias("r")), lambda s: F.transform(s["f"], lambda b, i: of(b, i, s["f"], s["r"])))
