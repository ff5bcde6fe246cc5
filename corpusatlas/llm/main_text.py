"""The main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block from where it
stands (menus, forms, adverts, comments and the like are out), from the share of its characters
inside links, from its length and from the share of function words among its words. Function
words are listed for some languages; on a page that has few of these, they are the page's own
commonest short words (characters, in scripts without spaces). Article elements count if they hold
at least as much text as lies densely outside them: then their blocks are main text, but for runs of blocks of nothing
but links, and all others are not. A small article beside longer text is a card.

The second pass gives every block that is not decided the label of its nearest decided
neighbours: in between two of the same label that one, in between two different ones the label of
the nearer, and if both are as near, that of the main text only if the block holds function
words. A run of link blocks inside an article stays in between its text; a longer one at its edge
goes. A page without any block of main text takes its undecided blocks, and then its sparse ones.

Defined cases: a null or empty page, and one without main text, give an empty text; an
unclosed comment, script or tag reaches to the end of the page; repeated rows are each
extracted; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusatlas.llm.quality import FUNCTION_WORDS

#: First pass: lengths in characters, shares of link characters and of function words.
SHORT, LONG = 70, 200
LINK_SHARE, LOW_SHARE, HIGH_SHARE = 0.33, 0.1, 0.2
#: A block of nothing but links, and how many of them in a row are a list of other pages at an article's edge.
LINKS_ONLY, LINK_RUN = 0.9, 3
#: The page's own function words: so many short words, each so often; a character of a script without
#: spaces is a word, and counts for so many characters of length.
OWN_WORDS, OWN_LENGTH, OWN_TIMES, WIDE = 20, 4, 3, 3

#: Elements whose content is no text of the page.
_SILENT = "script style noscript template head title svg math iframe object canvas select textarea button option datalist audio video".split()
#: Elements that begin and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
_CONTAINER = _BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr html body li dd dt td th tr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset(("td", "th"))
#: What the start of an element ends if its end tag was left out; any block ends a paragraph.
_ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": _CELLS, "th": _CELLS, "tr": {"tr"} | _CELLS}
_OUT = frozenset("nav aside footer form menu dialog fieldset".split())
_ARTICLE = frozenset(("article", "main"))
#: Words of class, id and role that mark what is not the article.
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar aside complementary footer contentinfo cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "teaser widget pagination pager search form toolbar disclaimer paywall".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
_HEADER_WORDS = frozenset("header masthead topbar".split())
#: Words that may stand beside these in a compound; any other word makes it another name (no-sidebar, tag-search).
_BESIDE = frozenset(
    "area article bar block body bottom box btn button buttons center column container content entry form global group "
    "holder icon icons inner item items left link links list main module page pane panel post posts primary right row "
    "secondary section site slot story tool tools top unit wrap wrapper x".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<silent>" + "|".join(_SILENT) + r")\b[^>]*>.*?(?:</(?P=silent)\s*>|(?=<body\b|<article\b)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Scripts without spaces: kana, Chinese characters, Thai, Lao, Khmer, Burmese.
_UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W\d_{_UNSPACED}]+")
_WIDE = re.compile(rf"[{_UNSPACED}]")


@dataclass
class Block:
    text: str
    link_share: float
    out: bool
    #: 1 inside `main`, 2 inside `article`.
    article: int
    heading: bool
    #: Where the elements begin whose names alone mark the block out.
    under: tuple[int, ...] = ()


def _marks(rest: str) -> set[str]:
    """The marking words of names that consist of them and of words that may stand beside them."""
    found = set()
    for m in _MARK.finditer(rest):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(re.split(r"[^a-z]+", name)) - {""}
            marks = words & (_OUT_WORDS | _COMMENT_WORDS | _HEADER_WORDS)
            if words - marks <= _BESIDE:
                found |= marks
    return found


def blocks(html: str, ignored: frozenset[int] = frozenset()) -> list[Block]:
    """The blocks with text in page order; names of elements that begin at `ignored` mark nothing."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = at = 0
    in_link = heading = False
    # (element, out, article, comment, under): what holds inside every open container.
    stack: list[tuple[str, bool, int, bool, tuple[int, ...]]] = [("", False, 0, False, ())]

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            size = sum(len(p.strip()) for p in pieces) or 1
            _, is_out, article, _, under = stack[-1]
            out.append(Block(text, linked / size, is_out, article, heading, under))
        pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    for m in _TAG.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["silent"] and m["silent"].lower() in ("head", "title"):
                close()
            continue
        ending = bool(m["close"])
        if name == "a":
            in_link = not ending
        elif name == "br":
            pieces.append(" ")
        if name not in _BLOCK:
            continue
        close()
        if name[0] == "h" and name[1:].isdigit():
            heading = not ending
        elif name not in ("hr",):
            heading = False
        if name in ("p", "li", "td", "div", "article", "section"):
            in_link = False
        if ending:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name or name in _HEADINGS and stack[depth][0] in _HEADINGS:
                    del stack[depth:]
                    break
                if name not in _CONTAINER and stack[depth][0] in _CONTAINER:
                    # The end of a paragraph or item does not reach out of its container.
                    break
            continue
        # An element that was left open ends here; only marked ones are on the stack.
        ended = _ENDS.get(name, set()) | {"p"}
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in _CONTAINER:
                break
            if stack[depth][0] in ended:
                del stack[depth:]
                break
        if name not in _CONTAINER and not m["rest"] or name == "hr":
            continue
        rest = m["rest"]
        marks = _marks(rest) if "=" in rest and name not in ("html", "body") else set()
        _, is_out, article, comment, under = stack[-1]
        comment = comment or bool(marks & _COMMENT_WORDS)
        hard = bool(name in _OUT or comment or _HIDDEN.search(rest)) or name == "header" and not article
        # A name says less than an article element, and less than what most of the page stands in.
        named = name not in _ARTICLE and m.start() not in ignored
        named = named and bool(marks & (_OUT_WORDS if article else _OUT_WORDS | _HEADER_WORDS))
        own = hard or named
        if name in _ARTICLE:
            # An article in a container that was left open is still the article.
            is_out, article, under = own, 0 if own else max(article, 1 + (name == "article")), ()
        else:
            if hard or article:
                under = ()
            elif named and (under or not is_out):
                under = (*under, m.start())
            is_out = is_out or own
        if name in _CONTAINER:
            stack.append((name, is_out, article, comment, under))
        elif own:
            # A paragraph or item marked by itself ends with its end tag or its next sibling.
            stack.append((name, True, article, comment, under))
    say(html[at:])
    close()
    return out


def judged_blocks(html: str) -> list[Block]:
    """The blocks, where no name of an element marks most of the page's text out."""
    ignored: frozenset[int] = frozenset()
    while True:
        found = blocks(html, ignored)
        held: Counter[int] = Counter()
        for block in found:
            held.update(dict.fromkeys(block.under, len(block.text)))
        total = sum(len(b.text) for b in found if b.under or not b.out)
        most = {at for at, size in held.items() if 2 * size > total}
        if not most:
            return found
        ignored |= most


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _function_words(found: list[Block]) -> frozenset[str]:
    """The listed function words, or the page's own if it has few of these."""
    words = [w for b in found if not b.out and b.link_share <= LINK_SHARE for w in _words(b.text)]
    listed = sum(w in FUNCTION_WORDS for w in words)
    if listed >= LOW_SHARE * len(words):
        return FUNCTION_WORDS
    short = Counter(w for w in words if len(w) <= OWN_LENGTH)
    return FUNCTION_WORDS | {w for w, n in short.most_common(OWN_WORDS) if n >= OWN_TIMES}


def _length(text: str) -> int:
    return len(text) + (WIDE - 1) * len(_WIDE.findall(text))


def _in_article(found: list[Block], level: int) -> list[bool | None]:
    """Labels where the page marks its article; blocks of nothing but links are left to their neighbours."""
    labels: list[bool | None] = [
        False if b.out or b.article < level else None if b.link_share >= LINKS_ONLY and not b.heading else True for b in found
    ]
    at = 0
    while at < len(labels):
        end = at
        while end < len(labels) and labels[end] is None:
            end += 1
        if end > at:
            inside = at > 0 and labels[at - 1] and end < len(labels) and labels[end]
            keep = inside or end - at < LINK_RUN
            labels[at:end] = [bool(keep)] * (end - at)
        at = end + 1
    for i in range(len(found) - 1, 0, -1):
        # A heading of `main` right above an article is the article's.
        if labels[i] and found[i - 1].heading and found[i - 1].article and not found[i - 1].out:
            labels[i - 1] = True
    if True not in labels:
        # An article of links alone.
        return [not b.out and b.article >= level for b in found]
    return labels


def _first_pass(block: Block, function_words: frozenset[str]) -> tuple[bool | None, bool]:
    """True for main text, False for the rest, None if the block is too short to tell; and whether it is only sparse."""
    if block.out or block.link_share > LINK_SHARE and not block.heading:
        return False, False
    length = _length(block.text)
    if block.heading or length < SHORT:
        return None, False
    words = _words(block.text)
    share = sum(w in function_words for w in words) / max(1, len(words))
    if share >= HIGH_SHARE or share >= LOW_SHARE and length > LONG:
        return True, False
    return (None, False) if share >= LOW_SHARE else (False, True)


def _marked_level(found: list[Block], function_words: frozenset[str]) -> int:
    """2 if article elements hold at least as much text as lies densely outside them, 1 if `main` does, else 0."""
    sizes = [0.0, 0.0, 0.0]
    for b in found:
        if not b.out and (b.article or _first_pass(b, function_words)[0]):
            sizes[b.article] += len(b.text) * (1 - b.link_share)
    total = sum(sizes)
    for level in (2, 1):
        if any(b.article >= level and not b.out for b in found) and 2 * sum(sizes[level:]) >= total:
            return level
    return 0


def _by_density(found: list[Block], function_words: frozenset[str]) -> list[bool | None]:
    """Labels of the first pass where no article is marked."""
    told = [_first_pass(b, function_words) for b in found]
    labels = [label for label, _ in told]
    if any(label and not b.article for b, label in zip(found, labels)):
        # Small articles beside the text are cards.
        labels = [False if label is None and b.article else label for b, label in zip(found, labels)]
    elif True not in labels:
        # No block is dense: long ones that are no links are all there is.
        long = [_length(b.text) >= SHORT and not b.heading for b in found]
        wanted = [label is None and big for label, big in zip(labels, long)]
        if not any(wanted):
            wanted = [sparse for _, sparse in told]
        labels = [True if want else label for want, label in zip(wanted, labels)]
    return labels


def _nearest(labels: list[bool | None]) -> list[tuple[int, bool | None]]:
    """Distance and label of the last decided block up to every block."""
    out, distance, last = [], 0, None
    for label in labels:
        distance, last = (0, label) if label is not None else (distance + 1, last)
        out.append((distance, last))
    return out


def _second_pass(found: list[Block], labels: list[bool | None], function_words: frozenset[str]) -> list[bool]:
    before, after = _nearest(labels), _nearest(labels[::-1])[::-1]
    out = []
    for block, label, (back, left), (ahead, right) in zip(found, labels, before, after):
        if label is None:
            if left is None and right is None:
                label = True
            elif left is None or right is None or left == right:
                label = right if left is None else left
            elif block.heading:
                # A heading belongs to what follows it.
                label = right
            elif back != ahead:
                label = left if back < ahead else right
            else:
                label = any(w in function_words for w in _words(block.text))
        out.append(label)
    return out


def main_text(html: str | None) -> str:
    # Names of elements mark what is out, unless they would take most of a page without an article.
    found = blocks(html or "")
    function_words = _function_words(found)
    level = _marked_level(found, function_words)
    if level:
        labels = _in_article(found, level)
    else:
        found = judged_blocks(html or "")
        function_words = _function_words(found)
        labels = _by_density(found, function_words)
    kept = _second_pass(found, labels, function_words)
    return "\n".join(b.text for b, good in zip(found, kept) if good)


def extracted(pages: DataFrame) -> DataFrame:
    """`(page_id, url, text)` for every row of `pages`."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    )
