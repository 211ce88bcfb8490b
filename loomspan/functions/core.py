"""Small building blocks for columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fenced code block.
FENCE = r"```[^\n`]*\n[\s\S]*?```"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body mentions it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


#: White space as Unicode has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end. Trimming looks at the ends only, where a pattern would try every blank."""
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    """Without white space at the end."""
    return F.rtrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def counted(text: Column, n: Column) -> Column:
    """What every text operator returns: the new text and how much it did."""
    return F.struct(text.alias("text"), n.cast("long").alias("n"))


def replace_matches(text: Column, pattern: str, new: Callable[[Column, Column, Column], Column], sure: bool = False) -> Column:
    """The text with each match replaced by new(match, position from 0, number of matches). sure: there is a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def join(m: Column) -> Column:
        after = F.concat(F.transform(m, lambda x, i: new(x, i, F.size(m))), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(text, pattern, -1), after, lambda a, b: F.concat(a, b)), "")

    return let(found, join) if sure else F.when(text.rlike(pattern), let(found, join)).otherwise(text)


def map_prose(text: Column, op: Callable[[Column], Column]) -> Column:
    """op on what stands outside fenced blocks; op gives counted(), and the counts add up. An unterminated fence at the
    start of a segment is left alone too."""
    one = lambda part: F.when(part.startswith("```"), counted(part, F.lit(0))).otherwise(op(part))
    parts = F.transform(F.split(text, FENCE, -1), lambda part: one(part))
    blocks = F.concat(F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), F.array(F.lit("")))

    def join(done: Column) -> Column:
        whole = F.array_join(F.zip_with(done["text"], blocks, lambda a, b: F.concat(a, b)), "")
        return counted(whole, F.aggregate(done["n"], F.lit(0).cast("long"), lambda s, x: s + x))

    return F.when(text.contains("```"), let(parts, join)).otherwise(one(text))
