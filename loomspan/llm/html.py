"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block tags. Scripts, styles, forms, menus, asides, footers, headers outside the article and
containers that are named as adverts, notices, comments and the like are left out with all that is in them.
First pass: a block is good, near, short or bad by its length, its share of stop words and its share of link text. Stop words
are those of four languages and, for any other, the frequent words that a page's long blocks have in common; where a page
has none at all they decide nothing. Second pass: blocks that aren't decided take the label of the nearest decided
neighbours, of two equally near ones the earlier; a near block is bad only between bad ones. Where a page marks its article,
blocks outside it are bad, and those inside are bad only where they are a menu: three or more in a row that are link text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm.words import pieces

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is it that for on with as was are be this by or an at from not have but they his her you we which "
    "der die das und ist in zu den von mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so "
    "le la les de des du un une et est en que qui dans pour par sur pas avec au ce il elle ne se plus son sa ses ou mais comme on nous vous "
    "el los las del y que no con una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo".split()
)
# Thresholds of the first pass, in characters and shares; blocks of a menu.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS, MENU = 70, 200, 0.30, 0.32, 0.2, 3
#: A page's own stop words: their share of its words, and their length at most.
COMMON, COMMON_LENGTH = 0.01, 6

# Element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDERS = frozenset("article aside blockquote body dd details dialog div dl dt fieldset figure footer form header li main menu nav ol option p section table tbody td tfoot th thead tr ul span button label select noscript iframe object canvas video audio svg template map head".split())
DROPPED = frozenset("nav aside footer form menu dialog button label select noscript iframe object canvas video audio svg template map head fieldset".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Elements that a start tag ends, and those that it doesn't look beyond.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tr": ("tr", "table"), "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody", "table"), "option": ("option", "select"),
}
ENDS = {name: (frozenset(ends.split()), frozenset(stop.split())) for name, (ends, stop) in ENDS.items()}
#: Elements that hold the article's own words: what they are called says nothing inside the article.
OWN = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr blockquote pre figcaption caption span".split())
# Words that name what isn't part of an article, and words that may stand beside them in a name.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner promo promos promotion sponsor sponsored sponsors sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar "
    "cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies widget widgets popup modal overlay pagination pager copyright legal skip toolbar".split()
)
BESIDE = frozenset("site main top bottom left right page post posts article articles list lists box bar block container wrapper wrap section area slot unit inner outer link links icon icons button buttons global primary secondary mobile desktop sticky fixed item items story stories content group panel message text google the form".split())
HIDDEN = frozenset("hidden sr-only visually-hidden screen-reader-text print-only".split())
REPLIES = frozenset("comment comments commentlist reply replies disqus".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ROLE = re.compile(r"(?i)^(?:navigation|banner|contentinfo|complementary|search|dialog|alertdialog|alert|form|menu|menubar|toolbar)$")
ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a class or id holds a whole name made of these words and what may stand beside them."""
    for token in value.split():
        parts = [x.lower() for x in PARTS.findall(token)]
        if any(x in names for x in parts) and all(x in names or x in NAMES or x in BESIDE or x.isdigit() or len(x) == 1 for x in parts):
            return True
    return False


def _bad(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is left out with all that is in it. inside: it stands in an article."""
    if name in DROPPED or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if key == "class" and any(x in HIDDEN for x in value.lower().split()):
                return True
            if name != "header" and not (name in OWN and inside) and name != "span" and _named(value, REPLIES if name == "article" else NAMES):
                return True
        elif key == "role" and name != "header" and ROLE.match(value) or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, in the article) of each block that isn't left out, in page order. The article is what
    article elements hold or, on a page without any, the main element."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    linked = links = out_of = breaks = 0
    depth = {"article": 0, "main": 0}
    stack: list[tuple[str, bool, str]] = []  # name, left out, what it marks

    def close() -> None:
        nonlocal linked
        if held:
            text = SPACE.sub(" ", "".join(held)).strip()
            if text:
                out.append((text, linked, 2 if depth["article"] else 1 if depth["main"] else 0))
            held.clear()
        linked = 0

    def text(part: str) -> None:
        nonlocal linked, breaks
        if part and not out_of:
            part = unescape(part) if "&" in part else part
            held.append(part)
            if not part.isspace():
                breaks = 0
            if links > 0:
                linked += len(SPACE.sub(" ", part))

    def pop(to: int) -> None:
        nonlocal out_of
        while len(stack) > to:
            _, bad, mark = stack.pop()
            out_of -= bad
            if mark:
                depth[mark] -= 1

    def end(names: frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return pop(k)
            if stack[k][0] in stop:
                return None

    at, last = 0, page.rfind(">") + 1  # beyond that no tag ends
    while m := TAG.search(page, at, last):
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(page)
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name, ending, attributes = name.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if name in RAW and not ending:
            over = re.compile(rf"(?i)</{name}\s*/?\s*>").search(page, at)
            at = over.end() if over else len(page)
            continue
        if name == "a":
            links = 0 if ending else 1
        elif name == "br":
            breaks += 1
            held.append(" ")
            if breaks > 1:
                close()
        if name in BLOCKS or name in DROPPED:
            close()
            breaks = 0
            k = len(stack) - 1
            while k >= 0 and stack[k][0] == "span":
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                pop(k)
        if name not in HOLDERS:
            continue
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in ("article", "body") and name not in ("html", "body", "main"):
                    break
            continue
        if name in ENDS:
            end(*ENDS[name])
        # a slash before the end means nothing in HTML, but for what is drawn
        if name == "svg" and attributes.endswith("/"):
            continue
        bad = _bad(name, attributes, depth["article"] + depth["main"] > 0)
        if bad or name != "span":
            mark = name if name in depth and not bad else ""
            if not mark and not bad and "role" in attributes.lower():
                mark = next((r for x in ATTRIBUTE.finditer(attributes) if x[1].lower() == "role" and (r := (x[2] or x[3] or x[4] or "").lower()) in depth), "")
            stack.append((name, bad, mark))
            out_of += bad
            if mark:
                depth[mark] += 1
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!][^<]*\Z", rest)
    text(rest[: cut.start()] if cut else rest)
    close()
    most = max((where for _, _, where in out), default=0)
    return [(text, linked, 0 < most == where) for text, linked, where in out]


def _stop_words(found: list[tuple[str, list[str]]]) -> frozenset[str]:
    """The page's own: short words that are frequent in it and stand in several of its long blocks."""
    long = [words for text, words in found if len(text) > LONG]
    total = sum(map(len, long))
    counts = Counter(w for words in long for w in words if len(w) <= COMMON_LENGTH)
    some = {w for w, n in counts.items() if n >= max(3, COMMON * total)}
    return frozenset(w for w in some if sum(w in words for words in long) > 1)


def main_text(page: str | None) -> str:
    """The good blocks, joined by line feeds."""
    found = blocks(page or "")
    marked = any(inside for _, _, inside in found)
    words = [WORD.findall(text.lower()) for text, _, _ in found]
    plain = [(found[k][0], words[k]) for k in range(len(found)) if found[k][1] <= LINKS * len(found[k][0])]
    stop = STOP_WORDS
    known = [w in stop for text, own in plain if len(text) >= SHORT for w in own]
    if sum(known) < STOP_LOW * len(known):
        stop |= _stop_words(plain)
        known = [w in stop for text, own in plain if len(text) >= SHORT for w in own]
    blind = sum(known) < STOP_LOW / 2 * len(known)  # a language without known stop words, or none
    links = [linked > 0.9 * len(text) for text, linked, _ in found]
    labels: list[str] = []
    for k, (text, linked, inside) in enumerate(found):
        n = len(text)
        stops = sum(w in stop for w in words[k]) / max(1, len(words[k]))
        if marked and not inside or not inside and n > 1 and linked > LINKS * n:
            label = "bad"
        elif n < SHORT:
            label = "short" if inside or not linked else "bad"
        elif stops >= STOP_HIGH and n > LONG:
            label = "good"
        elif stops >= STOP_LOW or blind or inside:
            label = "near"
        else:
            label = "bad"
        if inside and links[k]:  # a run of links is a menu
            a = b = k
            while a > 0 and links[a - 1] and found[a - 1][2] and k - a < MENU:
                a -= 1
            while b + 1 < len(found) and links[b + 1] and found[b + 1][2] and b - k < MENU:
                b += 1
            label = "bad" if b - a + 1 >= MENU else label
        labels.append(label)
    decided = [k for k, x in enumerate(labels) if x in ("good", "bad") and found[k][2] == marked]
    keep: list[str] = []
    at = 0
    for k, (text, _, inside) in enumerate(found):
        label = labels[k]
        while at < len(decided) and decided[at] < k:
            at += 1
        if label in ("short", "near"):
            near = [d for d in (decided[at - 1] if at else None, decided[at] if at < len(decided) else None) if d is not None]
            around = {labels[d] for d in near}
            if inside or around == {"good"} or not near:
                label = "good"
            elif around == {"bad"}:
                label = "good" if label == "near" and not any(x == "good" for x in labels) else "bad"
            else:
                label = "good" if label == "near" else labels[min(near, key=lambda d: abs(d - k))]
        if label == "good":
            keep.append(text)
    return "\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. A row for each input row: page_id, url, text, n_chars.

    A null, empty or textless page gives an empty text; rows that repeat give the same text each; an empty table gives an empty
    one; columns of other names are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
