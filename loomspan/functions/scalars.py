"""Scalar functions: tokens, keys, hashes, vectors, budgets, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.core import collapse, replace_matches, strip

# Output caps, directives and thresholds of the budget modes.
OUTPUT_CAPS = {"normal": 700, "saving": 300, "critical": 120}
DIRECTIVES = {
    "saving": "[Answer Budget: SAVING]\nLead with the direct answer. Max 3 short sections. Code only when it IS the answer. No preamble, no restatement, no closing summary.",
    "critical": "[Answer Budget: CRITICAL]\nUltra-compact hint-first response strictly under 60 words. Provide only the essential insight or minimal correction. Zero filler, zero pleasantries.",
}
# Digest names by number of hexadecimal digits.
DIGESTS = {32: "md5", 40: "sha1", 56: "sha224", 64: "sha256", 96: "sha384", 128: "sha512"}
CODE_BLOCK = r"```([a-zA-Z0-9_-]*)\s*\n([\s\S]*?)```"
DIMENSION = 384


def text_tokens(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, one at least; null counts as its four letters."""
    return F.greatest(F.lit(1).cast("long"), F.coalesce(F.floor(F.length(c) / 4), F.lit(1)).cast("long"))


def message_tokens(c: Column) -> Column:
    """A message's tokens with the four of its frame."""
    return text_tokens(c) + 4


def content_text(content: Column, parts: Column | None = None) -> Column:
    """The plain content, or the text parts joined by blanks, or nothing."""
    if parts is None:
        return F.coalesce(content, F.lit(""))
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.coalesce(content, F.array_join(texts, " "), F.lit(""))


def cache_key(c: Column) -> Column:
    return collapse(F.lower(c))


def cache_key_hash(c: Column) -> Column:
    return F.sha2(cache_key(c), 256)


def block_hash(c: Column) -> Column:
    """Eight hexadecimal digits that name a paragraph; letter case counts."""
    return F.left(F.sha2(collapse(c), 256), F.lit(8))


def fingerprint_code(c: Column) -> Column:
    """Each fenced block as its language and the hash of its code."""
    def short(m: Column, _i: Column, _n: Column) -> Column:
        code = strip(F.regexp_extract(m, CODE_BLOCK, 2))
        return F.concat(F.lit("[CodeBlock:"), F.regexp_extract(m, CODE_BLOCK, 1), F.lit(":"), F.left(F.sha2(code, 256), F.lit(8)), F.lit("]"))

    return replace_matches(c, CODE_BLOCK, short)


def embedding_terms(df: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """The hash embedding in sparse form: (key, idx, w), w scaled to length one; texts without a token have no row."""
    words = F.explode(F.filter(F.transform(F.split(F.col(text), r"(?U)\s+"), lambda w: F.lower(F.btrim(w, F.lit(".,!?;:()[]{}\"'")))), lambda w: w != ""))
    hashed = df.select(F.col(key), words.alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.sha2("w", 256))
    idx = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(dimension))
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = hashed.groupBy(key, idx.alias("idx")).agg(F.sum(F.col("n") * sign).alias("v")).where("v <> 0")
    length = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")).alias("len"))
    return sums.join(length, key).select(key, "idx", (F.col("v") / F.col("len")).alias("w"))


def dense(terms: DataFrame, key: str, dimension: int = DIMENSION) -> DataFrame:
    """Sparse vectors (key, idx, w) as arrays of `dimension` numbers."""
    held = terms.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "w"))).alias("_m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("long")), F.lit(0.0)))
    return held.select(key, at.alias("vector"))


def embed_preview(vector: Column, n: int = 8) -> Column:
    """The first numbers of a vector."""
    return F.slice(vector, 1, n)


def normalize(vector: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length == 0, vector).otherwise(F.transform(vector, lambda x: x / length))


def dot(a: Column, b: Column) -> Column:
    """Plain dot product; different lengths are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def human_size(n: Column) -> Column:
    kb = F.format_string("%.1fKB", n / 1024)
    mb = F.format_string("%.1fMB", n / (1024 * 1024))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024 * 1024, kb).otherwise(mb)


def digest_name(n: Column) -> Column:
    out = F
    for size, name in DIGESTS.items():
        out = out.when(n == size, F.lit(name))
    return out.otherwise(F.concat((n * 4).cast("string"), F.lit("-bit hash")))


def first_sentence(c: Column) -> Column:
    """Up to the first sentence end that white space follows."""
    return strip(F.element_at(F.split(strip(c), r"(?U)(?<=[.!?])\s+", 2), 1))


def budget_mode(requested: Column, raw_tokens: Column, default: str = "normal") -> Column:
    """The mode asked for, or the default; very long inputs are always critical, long ones saving instead of normal."""
    mode = F.lower(F.trim(F.coalesce(F.nullif(requested, F.lit("")), F.lit(default))))
    mode = F.when(mode.isin(*OUTPUT_CAPS), mode).otherwise("normal")
    return F.when(raw_tokens >= 4000, "critical").when((raw_tokens >= 2000) & (mode == "normal"), "saving").otherwise(mode)


def output_cap(mode: Column) -> Column:
    out = F
    for name, cap in OUTPUT_CAPS.items():
        out = out.when(F.lower(F.trim(mode)) == name, cap)
    return out.otherwise(300).cast("long")


def output_saved(mode: Column, actual: Column, baseline: Column | None = None) -> Column:
    """Output tokens saved against the measured baseline, or against the normal cap where there is none."""
    base = F.lit(OUTPUT_CAPS["normal"]) if baseline is None else F.when(baseline > 0, baseline).otherwise(OUTPUT_CAPS["normal"])
    return F.when(F.lower(F.trim(mode)) == "normal", 0).otherwise(F.greatest(F.lit(0), base - actual)).cast("long")


def directive(mode: Column) -> Column:
    out = F
    for name, text in DIRECTIVES.items():
        out = out.when(mode == name, F.lit(text))
    return out.otherwise("")


def verdict(answer: Column) -> Column:
    """What a verifier's reply says; anything unclear leaves the hit standing."""
    said = F.upper(strip(F.coalesce(answer, F.lit(""))))
    return F.when(said.startswith("YES"), "accept").when(said.startswith("NO"), "reject").otherwise("unavailable")


def verifier_input(question: Column, answer: Column) -> Column:
    """The pair as it is shown to a verifier: 600 and 1200 characters at most."""
    return F.struct(F.left(question, F.lit(600)).alias("question"), F.left(answer, F.lit(1200)).alias("answer"))


def tokens_used(total: Column, prompt: Column, completion: Column) -> Column:
    """A usage report's total, or the sum of its parts."""
    return F.coalesce(F.nullif(total, F.lit(0)), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))).cast("long")


def assistant_text(response: Column) -> Column:
    """The first choice's content of a response in JSON."""
    return F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.lit(""))
