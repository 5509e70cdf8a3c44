"""Main text of web pages by two-pass block rules (operator 5).

A page is cut into blocks at block-level tags. The first pass decides the clear ones by length, link density and the density of
stop words: blocks of links are boilerplate, long blocks of running text are text. Tags that say what they hold (nav, form,
footer ...) and containers that are named for it (class "ad") are boilerplate; a name that only has such a word in it
("cookie-notice", "related-work") is a hint, which counts unless what is so named is most of the page's running text. Some names say
either ("comment", "teaser"): one container of that name that holds nearly all running text is what the page is about. The second
pass gives short blocks, which say little, the label of the nearest decided block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.llm.common import rows_as, utf8

SCHEMA = "page_id long, url string, text string, n_blocks int, n_kept int"

# Stop words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can do for from had has have he her his if in into is it its more my no not of on one or
    our she so than that the their them then there they this to up was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me mes ne nos notre nous on ou
    par pas pour qu que qui sa sans se ses son sont sur ta te tu un une vos votre vous
    aber als am auch auf aus bei bin bis das dass dem den der die dies du durch ein eine einem einen einer er es euch für hat ich
    ihr im in ist ja kann man mich mir mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was
    wenn werden wie wir zu zum zur
    al algo como con cual cuando del desde donde el ella en entre era es esa ese eso esta está este esto fue ha hasta hay la
    las lo los más me mi muy no nos o para pero por porque que quien se ser si sin sobre su sus también te tiene todo un una y ya yo""".split()
)
# Tags by what they do to the text in them or around them.
DROPPED = "script style noscript template iframe object svg math canvas textarea select title".split()
BOILERPLATE = frozenset("nav footer aside form head button dialog menu fieldset label".split())
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table
    tbody td tfoot th thead tr ul""".split()
)
#: These end by themselves where the next block begins.
LEAVES = frozenset("p li dd dt td th tr option hr h1 h2 h3 h4 h5 h6 caption legend summary figcaption".split())
# Names in class, id or role attributes that mean boilerplate.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share captcha comment comments
    commentlist consent contentinfo cookie cookiebanner cookiebar cookies copyright cc-banner cc-window disclaimer disqus footer gdpr header login masthead menu menubar modal
    nav navbar navigation navigation-bar newsletter notice notices notification overlay pager pagination popup promo promoted
    promotion recommended related replies reply respond responses search share sharing sidebar signup social sponsor sponsored
    subscribe subscription teaser toolbar topbar widget widgets""".split()
)
# Those of them that an article may have too, if it is the only one of that name.
EITHER = frozenset("comment notice promo recommended related respond social teaser widget widgets".split())
# Names of what holds the article, and words that make a name say that something is there or not, not what it is.
CONTENT = frozenset("article body content entry main post prose story text".split())
STATES = frozenset("has is no non not with without hide show".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<dropped>" + "|".join(DROPPED) + r")\b(?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=dropped)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-zA-Z][^<>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS, SPACE, ENDS = re.compile(r"[^\W\d_]+"), re.compile(r"\s+"), re.compile(r"[.!?…。！？](?=\W|$)")


def named(attrs: str) -> tuple[bool, bool, str]:
    """Whether a container is named boilerplate, whether a name only has such a word in it, and the first name that says either."""
    hint = content = False
    either = ""
    for match in NAMED.finditer(attrs):
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            if name in EITHER:
                either = either or name
            elif name in NAMES:
                return True, False, ""
            parts = re.split(r"[_-]+", name)
            content |= name in CONTENT
            hint |= len(parts) > 1 and parts[0] not in STATES and not NAMES.isdisjoint(parts)
    return False, hint and not content, either


class Block:
    __slots__ = ("article", "boilerplate", "either", "heading", "hinted", "linked", "text")

    def __init__(self, text: str, linked: int, boilerplate: bool, hinted: bool, either: str, article: bool, heading: bool):
        self.text, self.linked, self.boilerplate, self.hinted, self.either, self.article, self.heading = text, linked, boilerplate, hinted, either, article, heading


class Stack:
    """The open containers, and how many of them say what, so that a block doesn't look through all."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool, bool, str]] = []  # name, boilerplate, article, hinted, a name that says either
        self.counts, self.names, self.either = [0, 0, 0], Counter(), []

    def push(self, name: str, boilerplate: bool, article: bool, hinted: bool, either: str) -> None:
        self.open.append((name, boilerplate, article, hinted, either))
        self.names[name] += 1
        self.counts = [n + x for n, x in zip(self.counts, (boilerplate, article, hinted), strict=True)]
        if either:
            self.either.append(either)

    def close(self, name: str) -> None:
        """Ends the innermost container of this name, if there is one, and those within it."""
        while self.names[name]:
            top, *says, either = self.open.pop()
            self.names[top] -= 1
            self.counts = [n - x for n, x in zip(self.counts, says, strict=True)]
            if either:
                self.either.pop()
            if top == name:
                return


def blocks(page: str) -> list[Block]:
    """The page's blocks with text in them: references decoded, white space as single spaces."""
    out: list[Block] = []
    parts: list[str] = []
    stack, times = Stack(), Counter()  # times: containers of each name that says either
    leaf, heading = (False, False, ""), False  # of the block that is open: what its names say; a heading
    linked, anchor, breaks, last = 0, 0, 0, 0

    def end() -> None:
        nonlocal linked, leaf, heading
        if parts:
            if text := SPACE.sub(" ", html.unescape("".join(parts))).strip():
                boilerplate, article, hinted = (n > 0 for n in stack.counts)
                out.append(Block(text, linked, leaf[0] or boilerplate, leaf[1] or hinted, leaf[2] or (stack.either[0] if stack.either else ""), article, heading))
            parts.clear()
        linked, leaf, heading = 0, (False, False, ""), False

    for match in TAG.finditer(page):
        if match.start() > last:
            piece = page[last : match.start()]
            parts.append(piece)
            if anchor:
                linked += len(piece.strip())
            if not piece.isspace():
                breaks = 0
        last = match.end()
        name = (match["name"] or "").lower()
        if name == "a":
            anchor = 0 if match["close"] else 1
        elif name == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:  # an empty line parts blocks
                kept = leaf, heading
                end()
                leaf, heading = kept
        elif name in BLOCKS:
            end()
            anchor = breaks = 0
            if match["close"]:
                if name not in LEAVES:
                    stack.close(name)
                continue
            marked, hinted, either = named(match["attrs"]) if match["attrs"] else (False, False, "")
            if either and name not in ("body", "html", "article", "main"):
                times[either] += 1
            if name in LEAVES:
                leaf, heading = (marked, hinted, either), len(name) == 2 and name[0] == "h" and name != "hr"
                continue
            if name == "body":
                stack = Stack()  # a head that was never closed
            article = name in ("article", "main") or stack.counts[1] > 0
            named_so = name not in ("body", "html", "article", "main")
            stack.push(name, name in BOILERPLATE or marked and named_so or name == "header" and not article, article, hinted and named_so, either if named_so else "")
    if last < len(page):
        parts.append(page[last:])
    end()
    for block in out:
        block.boilerplate |= times[block.either] > 1
    return out


def stop_words(text: str) -> float | None:
    """Their share of the words; None where most words are in a script that these languages don't use."""
    words = WORDS.findall(text.lower())
    if 2 * sum(w[0] < "\u0250" for w in words) <= len(words):
        return None
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(block: Block, long: int, stop_share: float, link_share: float) -> bool | None:
    """Whether a block is text; None if it doesn't say."""
    if block.boilerplate:
        return False
    size = len(block.text)
    if block.linked > link_share * size:
        return False if not block.article or size < long else None
    if size < long:
        return None
    share = stop_words(block.text)
    if block.article:  # its author's words, whatever they are, unless many of them are links and few hold others together
        return True if share is None or share >= stop_share or 2 * block.linked <= link_share * size else None
    if share is None or share >= stop_share:
        return True
    return None if len(ENDS.findall(block.text)) > 1 else False  # sentences, but in what language?


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Labels for the undecided blocks: the nearest decided one's. Of two as near, a heading takes the one it heads, any other
    block is text only if both are. Where nothing is decided, what stands in an article is text; where no block is text, those
    that end as sentences do are, and the headings above them."""
    n = len(found)
    if not any(labels) and not any(b.article and not b.boilerplate for b in found):
        ended = [x is None and ENDS.search(b.text, max(0, len(b.text) - 2)) is not None for b, x in zip(found, labels, strict=True)]
        return [e or (b.heading and x is None and any(ended[i + 1 :])) for i, (e, b, x) in enumerate(zip(ended, found, labels, strict=True))]
    before, after, near = [None] * n, [None] * n, None
    for i in range(n):
        near = i if labels[i] is not None and not found[i].boilerplate else near
        before[i] = near
    near = None
    for i in reversed(range(n)):
        near = i if labels[i] is not None and not found[i].boilerplate else near
        after[i] = near
    out = []
    for i, block in enumerate(found):
        if labels[i] is not None:
            out.append(labels[i])
            continue
        a, b = before[i], after[i]
        if block.article:  # its neighbours within the article, if it has any
            a = a if a is not None and found[a].article else None
            b = b if b is not None and found[b].article else None
        if a is None and b is None:
            out.append(block.article)
        elif a is None or b is None:
            out.append(labels[a if b is None else b])
        elif block.heading or i - a > b - i:
            out.append(labels[b])
        elif i - a < b - i:
            out.append(labels[a])
        else:
            out.append(labels[a] and labels[b])
    return out


def main_text(page: str, long: int = 70, stop_share: float = 0.25, link_share: float = 0.5) -> tuple[str, int, int]:
    """(text, blocks, blocks kept) of a page."""
    found = blocks(page)
    prose = [0 if b.boilerplate else len(b.text) - min(b.linked, len(b.text)) for b in found]
    if 5 * sum(n for n, b in zip(prose, found, strict=True) if b.either) <= 4 * sum(prose):
        for b in found:
            b.boilerplate |= b.either != ""
        prose = [0 if b.boilerplate else n for n, b in zip(prose, found, strict=True)]
    if 2 * sum(n for n, b in zip(prose, found, strict=True) if b.hinted) <= sum(prose):
        for b in found:
            b.boilerplate |= b.hinted
    kept = [b.text for b, is_text in zip(found, second_pass(found, [first_pass(b, long, stop_share, link_share) for b in found]), strict=True) if is_text]
    return "\n\n".join(kept), len(found), len(kept)


def extracted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    schema = rows_as(SCHEMA)
    for batch in batches:
        found = [main_text(body.as_py().decode("utf-8", "replace")) for body in batch.column("body")]
        texts, counts, kept = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kept, pa.int32())], schema=schema)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars (code points), n_blocks, n_kept.

    The text is the kept blocks in page order, joined by two newlines; empty if there are none, as for a null or empty page.
    Broken markup, unclosed tags included, is read as far as it goes, and text without any tag is one block. Repeated rows,
    null ids and null urls stay as they are. Other columns are not read. An empty table gives no rows.
    """
    named: Column = F.col(f"`{id_col}`").cast("long").alias("page_id")
    rows = pages.select(named, F.col(f"`{url_col}`").cast("string").alias("url"), utf8(html_col).alias("body"))
    return rows.mapInArrow(extracted, SCHEMA).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
