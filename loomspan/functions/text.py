"""Text operators as column expressions. Each gives counted(): the new text and how much it did."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.core import FENCE, collapse, counted, let, map_prose, replace_matches, rstrip, strip
from loomspan.functions.scalars import digest_name, human_size

# Patterns of secrets, in the order in which they are applied.
SECRETS = [
    r"\bvck_[A-Za-z0-9_]{25,}\b",
    r"\bsk[-_](?:proj[-_]|live[-_]|test[-_]|ant[-_])?[A-Za-z0-9-_]{20,}\b",
    r"\bgh[pousr]_[A-Za-z0-9_]{30,}\b",
    r"\bhf_[A-Za-z0-9]{30,}\b",
    r"\bAIza[0-9A-Za-z-_]{30,40}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\beyJ[A-Za-z0-9-_]+\.[A-Za-z0-9-_]+\.[A-Za-z0-9-_]+\b",
    r"(?i)\bBearer\s+[A-Za-z0-9\-_.~+/]{20,}\b",
]
KEY_VALUE = r"(?i)(\b(?:api[_-]?key|secret|token|password)\s*[:=]\s*['\"]?)([A-Za-z0-9-_]{16,})(['\"]?)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"

# Verbose phrases and their short forms.
PHRASES = [
    ("in spite of the fact that", "although"), ("it is important to note that", "note:"), ("due to the fact that", "because"),
    ("at this point in time", "now"), ("for the purpose of", "to"), ("with respect to", "regarding"), ("in the event that", "if"),
    ("on the other hand", "however"), ("with regard to", "regarding"), ("a large number of", "many"), ("in addition to", "besides"),
    ("first and foremost", "first"), ("each and every", "every"), ("in order to", "to"), ("whether or not", "whether"),
    ("as well as", "and"), ("the fact that", "that"), ("a number of", "several"), ("make sure to", "ensure"), ("be sure to", "ensure"),
    ("is able to", "can"), ("are able to", "can"), ("was able to", "could"), ("has the ability to", "can"), ("have the ability to", "can"),
    ("take into account", "consider"), ("take into consideration", "consider"), ("at the present time", "currently"),
    ("in the near future", "soon"), ("on a regular basis", "regularly"), ("in the process of", "currently"), ("prior to", "before"),
    ("subsequent to", "after"), ("in close proximity to", "near"), ("a sufficient number of", "enough"), ("in the majority of cases", "usually"),
    ("can you please explain to me in detail", "explain"), ("can you please explain to me", "explain"),
    ("could you please explain to me", "explain"), ("can you explain to me", "explain"), ("could you explain to me", "explain"),
    ("could you help me understand", "explain"), ("can you help me understand", "explain"), ("could you break it down for me", "explain"),
    ("I really need help understanding", "help me understand"), ("I am really struggling with", "I struggle with"),
    ("I am really confused about", "I am confused about"), ("I keep getting confused about", "I am confused about"),
    ("what I am trying to understand is", "my question:"), ("what I want to understand is", "my question:"),
    ("so basically what I mean is", "meaning:"), ("I was wondering if you could", "please"), ("I was just wondering if", ""),
    ("sorry I pasted that", "pasted"), ("ignore the messy parts", ""), ("ignore the repeats", ""),
    ("here is everything I tried", "my attempts:"), ("none of these are working", "these failed"), ("I really need to", "I need to"),
]
# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref_src", "ref_url", "yclid", "mc_cid", "mc_eid", "si", "igshid"]
# Addresses, and lines that only divide.
URL = r"(?i)https?://[^\s<>\"')]+"
DELIMITERS = r"(?dm)^[\t ]*([=\-_*~#])\1{7,}[\t ]*$"

# Patterns of what surrounds a question, in order of application.
GREETING_WORD = r"(?:hi|hello|hey|dear|good\s+(?:morning|afternoon|evening)|greetings)\b"
GREETING = GREETING_WORD + r"(?:\s+(?:professor|prof|teacher|tutor|sir|ma'?am|there|ai|bot|assistant|everyone|friends))?[,!.:;\-—\s]*"
PLEASANTRY = r"(?iU)^(?:(?:i\s+)?hope\s+(?:you\s+are|you're)\s+(?:doing\s+well|having\s+a\s+(?:great|good|wonderful|nice)\s+day|well|good)|i\s+hope\s+(?:this\s+finds\s+you\s+well|all\s+is\s+well|you\s+are\s+well|you're\s+doing\s+well))[,!.:;\s]*"
PREAMBLES = [
    r"\b(?:i\s+am|i'm)\s+(?:really\s+|extremely\s+|super\s+|very\s+)?(?:stressed|anxious|panicking|in\s+a\s+state\s+of\s+panic|freaking\s+out|overwhelmed)[^.!?]*?(?:[.!?]|\band\b|\bso\b|\bbecause\b)\s*",
    r"\b(?:i\s+really\s+really\s+need|i\s+really\s+need|i\s+urgently\s+need)\s+(?:your\s+help|help|assistance|to\s+understand)[^.!?]*?[.!?]\s*",
    r"\b(?:i\s+cannot\s+understand|i\s+don't\s+understand|i\s+can't\s+get\s+my\s+head\s+around)\s+[^.!?]*?[.!?]\s*",
    r"\b(?:i\s+am|i'm)\s+(?:currently\s+)?(?:preparing|studying)\s+(?:for\s+)?(?:my\s+)?[^.!?]*?(?:midterm|final|exam|test|quiz|interview|class|course|homework|assignment)[^.!?]*?(?:[.!?]|\band\b)\s*",
    r"\b(?:because\s+)?(?:i\s+have|i've\s+got)\s+(?:my\s+|an?\s+)?[^.!?]*?(?:exam|test|quiz|interview|midterm|final|class|deadline)[^.!?]*?(?:tomorrow|today|soon|coming\s+up|in\s+an?\s+hour|morning|next\s+week)[^.!?]*?(?:[.!?]|\band\b)\s*",
    r"\b(?:i\s+am|i'm)\s+(?:a\s+)?(?:beginner|new|struggling|confused)\s+(?:at|with|in|to)?\s*[^.!?]*?\s*(?:and|so)\s+",
    r"\b(?:i\s+am|i'm)\s+(?:really\s+)?(?:confused|stuck)\s+(?:about|on|with)\s+[^.!?]*?(?:concept|topic|thing)?[,.]*\s*",
    r"\b(?:as\s+a\s+matter\s+of\s+fact|to\s+be\s+completely\s+honest|honestly\s+speaking)[,\s]+",
    r"\b(?:what\s+i\s+(?:really\s+)?(?:want|need)\s+to\s+know\s+is)\s+",
    r"\b(?:i\s+was\s+wondering\s+if\s+you\s+(?:could|can)\s+(?:please\s+)?(?:explain|tell\s+me))\s+",
    r"\b(?:could\s+you\s+(?:please\s+)?(?:explain\s+to\s+me|tell\s+me|help\s+me\s+understand))\s+",
    r"\b(?:can\s+you\s+(?:please\s+)?(?:explain\s+to\s+me|tell\s+me|help\s+me\s+understand))\s+",
    r"\b(?:i\s+really\s+need\s+a\s+clear\s+explanation\s+of)\s+",
]
HEDGES = r"\b(?:basically|sort\s+of|kind\s+of|more\s+or\s+less)\b\s*"
SIGNOFF = (
    r"(?:thanks\s+(?:so\s+much\s+)?in\s+advance(?:\s+for\s+(?:your\s+)?help)?"
    r"|thank\s+you(?:\s+(?:so\s+much|very\s+much|a\s+lot))?(?:\s+in\s+advance)?(?:\s+for\s+(?:your\s+)?(?:help|time|assistance))?"
    r"|thanks(?:\s+(?:so\s+much|very\s+much|a\s+lot))?(?:\s+in\s+advance)?"
    r"|(?:i\s+)?(?:truly\s+)?appreciate\s+(?:everything\s+you\s+do|your\s+help|it)"
    r"|have\s+a\s+(?:great|wonderful|good|nice)\s+(?:day|rest\s+of\s+(?:your\s+)?day)"
    r"|please\s+help(?:\s+me)?(?:\s+asap|\s+soon)?"
    r"|any\s+help\s+(?:would\s+be|is)\s+(?:greatly\s+)?appreciated)"
)

# Opaque data.
DATA_URI = r"(?i)data:([a-zA-Z0-9]+/[a-zA-Z0-9\-\+\.]+);base64,([A-Za-z0-9+/=]{100,})"
LONG_HEX = r"(?<![a-fA-F0-9])([a-fA-F0-9]{64,})(?![a-fA-F0-9])"
BASE64 = r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{128,}={0,2})(?![A-Za-z0-9+/=])"
# A possessive group is a loop to the JVM's matcher; a greedy one recurses, and a long line overflows the stack.
HEX_LINE = r"(?dm)^[ \t]*(?:0x)?[0-9a-fA-F]{2}(?:[ \t]+(?:0x)?[0-9a-fA-F]{2}){7,}+"


def _numbered(state: Column, pattern: str, kind: str, by: str, keep: bool = False) -> Column:
    """state with the matches of a pattern replaced; `by` names the counter. The last match has the lowest number. A text
    without a match is scanned once."""
    base, fields = state[by], ("secrets", "emails", "phones")

    def one(m: Column, i: Column, n: Column) -> Column:
        tag = F.concat(F.lit(f"[REDACTED_{kind}_"), (base + n - i).cast("string"), F.lit("]"))
        return F.concat(F.regexp_extract(m, pattern, 1), tag, F.regexp_extract(m, pattern, 3)) if keep else tag

    def changed(n: Column) -> Column:
        return F.struct(replace_matches(state["text"], pattern, one, sure=True).alias("text"), *((base + n if c == by else state[c]).alias(c) for c in fields))

    return let(F.regexp_count(state["text"], F.lit(pattern)).cast("long"), lambda n: F.when(n > 0, changed(n)).otherwise(state))


#: (pattern, kind of placeholder, counter, whether the key before a secret stays), in this order.
GUARDS = [*((p, "SECRET", "secrets", False) for p in SECRETS), (KEY_VALUE, "SECRET", "secrets", True), (EMAIL, "EMAIL", "emails", False), (PHONE, "PHONE", "phones", False)]
#: Digits, an @ or a key word with enough behind it: nothing else can match.
GUARDED = r"\d{3}|@|[A-Za-z0-9_.~+/-]{16}"


def _guard(text: Column, step: Callable[..., Column]) -> Column:
    zero = F.lit(0).cast("long")
    state = F.struct(text.alias("text"), zero.alias("secrets"), zero.alias("emails"), zero.alias("phones"))
    done = reduce(lambda s, x: let(s, lambda t: step(t, *x)), GUARDS, state)
    return F.when(text.rlike(GUARDED), done).otherwise(state)


def redact(text: Column) -> Column:
    """struct<text, secrets, emails, phones>: secrets, mail addresses and phone numbers behind numbered placeholders."""
    return _guard(text, _numbered)


def redact_counts(text: Column) -> Column:
    """The same without the text that redact() makes: the placeholders aren't numbered and no list of matches is built."""
    def step(state: Column, pattern: str, kind: str, by: str, keep: bool) -> Column:
        tag = f"$1[REDACTED_{kind}_1]$3" if keep else f"[REDACTED_{kind}_1]"
        new = lambda n: F.struct(F.regexp_replace(state["text"], pattern, tag).alias("text"), *((state[c] + n if c == by else state[c]).alias(c) for c in ("secrets", "emails", "phones")))
        return let(F.regexp_count(state["text"], F.lit(pattern)).cast("long"), lambda n: F.when(n > 0, new(n)).otherwise(state))

    return _guard(text, step)


def redact_parts(parts: Column) -> Column:
    """struct<parts, secrets, pii> of a multipart content: text parts are redacted each by itself, other parts stay."""
    done = F.transform(parts, lambda p: F.struct(p.alias("p"), F.when((p["type"] == "text") & p["text"].isNotNull(), redact(p["text"])).alias("r")))

    def result(d: Column) -> Column:
        new = F.transform(d, lambda x: F.when(x["r"].isNotNull(), x["p"].withField("text", x["r"]["text"])).otherwise(x["p"]))
        total = lambda f: F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(f(x["r"]), F.lit(0).cast("long")))
        return F.struct(new.alias("parts"), total(lambda r: r["secrets"]).alias("secrets"), total(lambda r: r["emails"] + r["phones"]).alias("pii"))

    return let(done, result)


def dedup_sentences(text: Column) -> Column:
    """Later copies of a sentence of 20 characters or more go; the first says how many there were. Copies are found by sorting,
    so that the work grows with the sentences and not with their pairs."""
    def segment(part: Column) -> Column:
        sentences = F.split(part, r"(?U)(?<=[.!?])\s+|\n", -1)
        # a sentence that is too short is like no other
        row = lambda s, i: F.struct(F.when(F.length(strip(s)) >= 20, collapse(F.lower(s))).otherwise(F.concat(F.lit("\0"), i.cast("string"))).alias("key"), i.alias("at"), s.alias("s"))

        def fold(rows: Column) -> Column:
            n = F.size(rows)
            heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(rows, i)["key"] != F.get(rows, i - 1)["key"]))

            def said(first: Column, times: Column) -> Column:
                return F.when(times > 1, F.concat(rstrip(first["s"]), F.lit(" [x"), times.cast("string"), F.lit("]"))).otherwise(first["s"])

            def kept(h: Column) -> Column:
                one = lambda i, r: F.struct(F.get(rows, i)["at"].alias("at"), said(F.get(rows, i), F.coalesce(F.get(h, r + 1), n) - i).alias("s"))
                lines = F.transform(F.array_sort(F.transform(h, one)), lambda x: x["s"])
                return F.when(F.size(h) < n, counted(F.array_join(lines, "\n"), n - F.size(h))).otherwise(counted(part, F.lit(0)))

            return let(heads, kept)

        return let(F.array_sort(F.transform(sentences, row)), fold)

    return F.when(F.length(text) >= 40, map_prose(text, segment)).otherwise(counted(text, F.lit(0)))


def _peel(c: Column, word: str, pattern: str) -> Column:
    """pattern removed again and again, at most as often as word occurs. A repeated group would do the same, but such
    groups recurse in the JVM's matcher and a long chain overflows its stack."""
    n = F.regexp_count(c, F.lit(f"(?iU){word}"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), c, lambda s, _: F.regexp_replace(s, f"(?iU){pattern}", ""))).otherwise(c)


def strip_preamble(text: Column) -> Column:
    """The question without greetings, status reports, hedges and thanks; code is left alone."""
    code = r"```[\s\S]*?```|`[^`\n]+`"
    found = F.regexp_extract_all(text, F.lit(code), F.lit(0))
    tag = lambda i: F.concat(F.lit("__CODE_BLOCK_"), i.cast("string"), F.lit("__"))
    masked = replace_matches(text, code, lambda _m, i, _n: tag(i))

    def shorten(m: Column) -> Column:
        c = strip(_peel(m, GREETING_WORD, f"^{GREETING}"))
        c = strip(F.regexp_replace(c, PLEASANTRY, ""))
        for p in PREAMBLES:
            c = strip(F.regexp_replace(c, f"(?iU){p}", ""))
        c = strip(F.regexp_replace(c, f"(?iU){HEDGES}", ""))
        c = let(c, lambda x: F.struct(x.alias("old"), _peel(x, SIGNOFF, rf"{SIGNOFF}[,.\s!]*$").alias("new")))
        c = let(c, lambda x: F.when(x["new"] != x["old"], strip(F.regexp_replace(x["new"], r"(?U)[,.\s\-—]+$", ""))).otherwise(x["old"]))
        c = F.regexp_replace(c, r"(?U)^[,\s.:;\-—]+", "")
        c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"[ \t]+([,.?!])", "$1")
        return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))

    def finish(c: Column) -> Column:
        c = F.when(F.length(c["new"]) < 2, c["masked"]).otherwise(c["new"])
        return F.when(c.rlike(r"^\p{Ll}"), F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.length(c)))).otherwise(c)

    def restore(c: Column) -> Column:
        pairs = F.transform(found, lambda b, i: F.struct(tag(i).alias("tag"), b.alias("block")))
        return F.aggregate(pairs, c, lambda s, p: F.replace(s, p["tag"], p["block"]))

    new = restore(let(let(masked, lambda m: F.struct(shorten(m).alias("new"), m.alias("masked"))), finish))
    pick = lambda x: F.when((x != text) & (F.length(x) < F.length(text)), counted(x, F.lit(1))).otherwise(counted(text, F.lit(0)))
    return F.when(F.length(strip(text)) >= 10, let(new, pick)).otherwise(counted(text, F.lit(0)))


def compact_phrases(text: Column) -> Column:
    """Verbose phrases become short, the longest first, whole words in any letter case."""
    rules = sorted(PHRASES, key=lambda x: -len(x[0]))
    any_ = r"(?iU)\b(?:" + "|".join(p for p, _ in rules) + r")\b"
    table = F.array(*(F.struct(F.lit(rf"(?iU)\b{p}\b").alias("p"), F.lit(r).alias("r")) for p, r in rules))

    def segment(part: Column) -> Column:
        # only segments that hold some phrase go through the list
        step = lambda s, rule: F.struct(F.regexp_replace(s["text"], rule["p"], rule["r"]).alias("text"), (s["n"] + F.regexp_count(s["text"], rule["p"])).alias("n"))
        done = F.aggregate(table, F.struct(part.alias("text"), F.lit(0).cast("long").alias("n")), step)
        return F.when(part.rlike(any_), let(done, lambda s: counted(F.regexp_replace(s["text"], "  +", " "), s["n"]))).otherwise(counted(part, F.lit(0)))

    return F.when(F.length(text) > 30, map_prose(text, segment)).otherwise(counted(text, F.lit(0)))


def clean_url(url: Column) -> Column:
    """A URL without tracking parameters; what else its query holds is decoded and encoded again."""
    base, tail = F.regexp_extract(url, r"^([^?#]*)\?", 1), F.regexp_extract(url, r"^[^#]*(#.*)$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    plain = lambda s: F.coalesce(F.try_url_decode(s), s)
    quote = lambda s: F.replace(F.replace(F.url_encode(plain(s)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(p.contains("="), F.substring(p, F.length(name(p)) + 2, F.length(p))).otherwise("")
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.lower(plain(name(p))).isin(*TRACKING))
    new = F.array_join(F.transform(kept, lambda p: F.concat(quote(name(p)), F.lit("="), quote(value(p)))), "&")
    joined = F.concat(base, F.when(new != "", F.concat(F.lit("?"), new)).otherwise(""), F.when(tail != "#", tail).otherwise(""))
    return F.when(query != "", joined).otherwise(url)


def normalize_structure(text: Column) -> Column:
    """Tracking parameters, delimiter lines, tabs, blanks, table padding and blank lines, outside code."""
    long = lambda n: n.cast("long")

    def links(part: Column) -> Column:
        pairs = F.transform(F.regexp_extract_all(part, F.lit(URL), F.lit(0)), lambda u: F.struct(u.alias("old"), clean_url(u).alias("new")))
        def join(p: Column) -> Column:
            whole = F.array_join(F.zip_with(F.split(part, URL, -1), F.concat(p["new"], F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
            return counted(whole, F.size(F.filter(p, lambda x: x["old"] != x["new"])))

        return F.when(part.rlike(URL), let(pairs, join)).otherwise(counted(part, F.lit(0)))

    def line(x: Column) -> Column:
        right = rstrip(x)
        bare = strip(x)
        prose = F.when((bare != "") & ~bare.rlike(r"^[-*+>|]|^(?U)\d+\."), bare).otherwise(right)
        cells = F.split(F.substring(bare, F.lit(2), F.length(bare) - 2), r"\|", -1)
        table = F.concat(F.lit("| "), F.array_join(F.transform(cells, strip), " | "), F.lit(" |"))
        return F.when(bare.startswith("|") & bare.endswith("|") & (F.length(bare) >= 2), table).otherwise(prose)

    def step(s: Column, pattern: str, new: str) -> Column:
        return counted(F.regexp_replace(s["text"], pattern, new), s["n"] + long(F.regexp_count(s["text"], F.lit(pattern))))

    def segment(part: Column) -> Column:
        s = let(links(part), lambda s: step(s, DELIMITERS, "---"))
        s = let(s, lambda s: step(s, "\t", " "))
        s = let(s, lambda s: step(s, "  +", " "))
        s = let(s, lambda s: counted(F.array_join(F.transform(F.split(s["text"], "\n", -1), line), "\n"), s["n"]))
        s = let(s, lambda s: step(s, "\n{3,}", "\n\n"))
        return let(s, _trim_lines)

    pick = lambda s: F.when(s["n"] > 0, s).otherwise(counted(text, F.lit(0)))
    return F.when(F.length(text) > 20, let(map_prose(text, segment), pick)).otherwise(counted(text, F.lit(0)))


def _trim_lines(s: Column) -> Column:
    """Line feeds at either end go; that counts as one change."""
    new = F.regexp_replace(s["text"], r"\A\n+|\n+\z", "")
    return counted(new, s["n"] + F.when(new != s["text"], 1).otherwise(0))


def describe_binary(text: Column) -> Column:
    """Data URIs, long digests, base64 and hex dumps become short descriptions."""
    bytes_of = lambda s: F.ceil(F.length(s) * 3 / 4).cast("long")

    def replaced(s: Column, pattern: str, new) -> Column:
        pairs = F.transform(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("old"), new(m).alias("new")))
        def join(p: Column) -> Column:
            whole = F.array_join(F.zip_with(F.split(s["text"], pattern, -1), F.concat(p["new"], F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
            return counted(whole, s["n"] + F.size(F.filter(p, lambda x: x["old"] != x["new"])))

        return F.when(s["text"].rlike(pattern), let(pairs, join)).otherwise(s)

    def uri(m: Column) -> Column:
        return F.concat(F.lit("[Embedded base64 data: ~"), human_size(bytes_of(F.regexp_extract(m, DATA_URI, 2))), F.lit(" "), F.regexp_extract(m, DATA_URI, 1), F.lit("]"))

    def b64(m: Column) -> Column:
        mixed = m.rlike("[+/]") | (m.rlike("[A-Z]") & m.rlike("[a-z]"))
        return F.when(mixed, F.concat(F.lit("[Base64 data: ~"), human_size(bytes_of(m)), F.lit("]"))).otherwise(m)

    def dump(s: Column) -> Column:
        lines = F.regexp_extract_all(s["text"], F.lit(HEX_LINE), F.lit(0))
        size = F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit(r"(?:0x)?[0-9a-fA-F]{2}")))
        rest = strip(F.regexp_replace(F.regexp_replace(s["text"], HEX_LINE, ""), r"\n{3,}", "\n\n"))
        said = F.concat(F.lit("[Hex dump: "), size.cast("string"), F.lit(" bytes]"))
        return F.when(F.size(lines) >= 2, counted(F.when(rest != "", F.concat(rest, F.lit("\n"), said)).otherwise(said), s["n"] + 1)).otherwise(s)

    def segment(part: Column) -> Column:
        s = let(counted(part, F.lit(0)), lambda s: replaced(s, DATA_URI, uri))
        s = let(s, lambda s: replaced(s, LONG_HEX, lambda m: F.concat(F.lit("["), digest_name(F.length(m)), F.lit(" digest]"))))
        s = let(s, lambda s: replaced(s, BASE64, b64))
        return let(s, dump)

    pick = lambda s: F.when(s["n"] > 0, s).otherwise(counted(text, F.lit(0)))
    return F.when(F.length(text) > 100, let(map_prose(text, segment), pick)).otherwise(counted(text, F.lit(0)))


# Comments of markup that go; what a telling sentence holds, with the weights below.
HTML_COMMENT = r"<!--(?!\[if\s)[\s\S]*?-->"
DEFINITION = r"(?iU)\b(?:is defined as|refers to|is the|means that|is a|are a)\b|\b(?:definition|formula|equation|theorem|law|principle|rule)\b"
FORMULA = r"[=<>≤≥]+.*[a-zA-Z].*[=<>≤≥+\-*/^]"


def strip_html_comments(text: Column) -> Column:
    """Comments of markup; conditional ones stay."""
    return counted(F.regexp_replace(text, HTML_COMMENT, ""), F.regexp_count(text, F.lit(HTML_COMMENT)))


def sentence_score(s: Column) -> Column:
    """How much a sentence tells: definitions, formulas, bold terms, list items, numbers and length."""
    c = strip(s)
    score = (
        F.when(c.rlike(DEFINITION), 3.0).otherwise(0.0) + F.when(c.rlike(FORMULA), 4.0).otherwise(0.0) + F.regexp_count(c, F.lit(r"\*\*[^*]+\*\*")) * 1.5
        + F.when(c.rlike(r"(?U)\A\s*(?:\d+[.):]|[-•*])\s+"), 1.5).otherwise(0.0) + F.when(c.rlike(r"(?U)\d"), 0.5).otherwise(0.0)
        + F.when(F.length(c) > 80, 0.5).otherwise(0.0) - F.when(F.length(c) < 30, 1.0).otherwise(0.0)
    )
    return F.when(F.length(c) < 10, 0.0).otherwise(F.greatest(F.lit(0.0), score))


def summarize_response(text: Column, most: int = 200) -> Column:
    """The best sentences of a long answer in their order, and its code."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    prose = strip(F.regexp_replace(text, FENCE, ""))
    sentences = F.filter(F.transform(F.split(prose, r"(?U)(?<=[.!?])\s+", -1), strip), lambda s: s != "")
    last = lambda s: (F.size(sentences) - F.array_position(F.reverse(sentences), s)).cast("int")
    # a sentence that repeats stands where it stood last
    rows = F.transform(sentences, lambda s, i: F.struct((-sentence_score(s)).alias("rank"), i.alias("turn"), last(s).alias("pos"), s.alias("s")))

    def take(sorted_: Column) -> Column:
        zero = F.struct(F.array().cast("array<struct<pos:int,s:string>>").alias("kept"), F.lit(0).alias("size"), F.lit(False).alias("full"))

        def step(a: Column, x: Column) -> Column:
            stop = a["full"] | ((a["size"] + F.length(x["s"]) > most) & (F.size(a["kept"]) > 0))
            more = F.concat(a["kept"], F.array(F.struct(x["pos"].cast("int").alias("pos"), x["s"].alias("s"))))
            return F.when(stop, F.struct(a["kept"].alias("kept"), a["size"].alias("size"), F.lit(True).alias("full"))).otherwise(F.struct(more.alias("kept"), (a["size"] + F.length(x["s"])).alias("size"), F.lit(False).alias("full")))

        return F.aggregate(sorted_, zero, step, lambda a: F.array_sort(a["kept"]))

    kept = let(F.array_sort(rows), take)
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    code = F.when(F.size(blocks) > 0, F.concat(F.lit("\n"), F.array_join(blocks, "\n"))).otherwise("")
    whole = F.concat(F.lit("[AI prior response (~"), words.cast("string"), F.lit(" words): "), F.array_join(let(kept, lambda k: k["s"]), " "), code, F.lit("]"))
    short = F.when(F.size(sentences) == 0, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(whole)
    return F.when(F.length(text) > most, short).otherwise(text)
