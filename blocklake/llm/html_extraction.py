"""HTML main text by two-pass block rules.

A helper cuts a page into text blocks and counts characters, words, stop words and
linked characters of each. Pass one scores a block by stop-word density, length and
link density; the element it stands in and the names of that element's class or id
shift the score. Pass two gives each ambiguous block the label of its nearest decided
neighbours. Every step takes time in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklake.llm.common import map_rows

#: Frequent words of the languages at hand; a parameter.
STOP_WORDS = frozenset(
    """
    the of and a to in is it that was for on are as with his they at be this from have or by had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now my made over did down only way may
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde
    le la les de des du un une et en est que qui dans pour par sur au aux il elle on ne pas plus ce se avec sont son sa ses ou mais comme nous vous ils été cette
    el los las y que en un una por con no se su al lo como más para del es o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también
    """.split()
)
#: Elements that end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never text of the page.
SILENT_TAGS = frozenset("script style noscript template iframe object embed applet canvas svg math video audio map head title textarea button select option input".split())
#: Of these, what holds no tags: it ends at its end tag only.
RAW_TAGS = frozenset("script style iframe title textarea".split())
#: Elements that hold no article text, wherever they stand; a form or a header may hold the article itself.
BAD_TAGS = frozenset("nav footer aside menu dialog fieldset".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end one of their kind that is still open, and what they can't reach beyond.
SELF_ENDING = frozenset("p li dt dd td th tr option button".split())
BOUNDS = frozenset("ul ol dl table div article section main nav aside footer header form".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Words at either end of a class or id that say what a part is, unless it holds most of the page.
STRONG_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer sidebar widget share sharing comment comments commentlist disqus reply replies respond copyright toolbar".split())
#: Words that an article's own parts can have as well: they only lower the score.
WEAK_NAMES = frozenset("related recommended recommendations discussion social header menu form search side aside disclaimer skip".split())
#: Before these a name says what a part has or lacks, not what it is.
MODIFIERS = frozenset("has no with without is not non hide show".split())
BAD_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar toolbar".split())
#: Elements that the article as a whole stands in, and words in class or id that say so.
GOOD_TAGS = frozenset(("article", "main"))
GOOD_NAMES = frozenset(("article", "content", "entry", "story", "post", "main"))
#: Stop words to words of a likely and of a possible article block; characters of a short block; the share of linked characters that speaks against one.
STOP_HIGH, STOP_LOW, SHORT, LINK_LIMIT = 0.2, 0.12, 70, 0.33

_MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_ATTR = re.compile(r"""[\s/]*+(?:([^\s=>/"'][^\s=>/]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*+))?)?|["'=])""")
_CLOSE = re.compile(r"[\s/]*+>?")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW_TAGS}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Tag:
    """A tag or what else is no text. name is empty for comments, declarations and raw elements."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    empty: bool = False
    attrs: dict[str, str] = field(default_factory=dict)


def tags(page: str) -> Iterator[Tag]:
    """Everything in a page that is no text. A tag that is cut off reaches to the end."""
    at = 0
    while m := _MARK.search(page, at):
        start, at, name = m.start(), m.end(), (m.group(2) or "").lower()
        if not name:
            ends, sought = (3, page.find("-->", start + 2)) if m.group(3) else (1, page.find(">", at))
            at = sought + ends if sought >= 0 else len(page)
            yield Tag(start, at)
            continue
        attrs: dict[str, str] = {}
        while a := _ATTR.match(page, at):
            at = a.end()
            if a.group(1):
                attrs.setdefault(a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or "")
        close = _CLOSE.match(page, at).group()
        at += len(close)
        if not close.endswith(">"):
            yield Tag(start, len(page))
            return
        empty = "/" in close
        if name in RAW_TAGS and not m.group(1) and not empty:
            end = _RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            name = ""
        yield Tag(start, at, name, bool(m.group(1)), empty, attrs)


@dataclass(slots=True, eq=False)
class Part:
    """An open element. Its names do not count if it is the article, or holds most of its text, or most of a page without any."""

    name: str
    parent: Part | None = None
    hidden: bool = False
    hard: bool = False
    strong: bool = False
    weak: bool = False
    article: bool = False
    main: bool = False
    silent: bool = False
    inside: bool = False
    chars: int = 0
    article_chars: int = 0


class Open:
    """The open elements: the last of a name, of the bounds and of the silent ones is at hand without a search."""

    def __init__(self):
        self.parts: list[Part] = []
        self.places: dict[str, list[int]] = {}
        self.bounds: list[int] = []
        self.silent: list[int] = []

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def push(self, part: Part) -> None:
        at = len(self.parts)
        self.parts.append(part)
        self.places.setdefault(part.name, []).append(at)
        if part.name in BOUNDS:
            self.bounds.append(at)
        if part.silent:
            self.silent.append(at)

    def cut(self, at: int) -> None:
        """Ends the elements from a place on."""
        while len(self.parts) > at:
            part = self.parts.pop()
            self.places[part.name].pop()
            if part.name in BOUNDS:
                self.bounds.pop()
            if part.silent:
                self.silent.pop()

    def end_own_kind(self, name: str) -> None:
        at = self.last(name)
        if at >= 0 and (not self.bounds or self.bounds[-1] < at):
            self.cut(at)


def silent_ends(found: list[Tag]) -> dict[int, int]:
    """For silent elements with an end tag of their own: the number of that tag by that of the start tag. The others end with the part around them."""
    out, numbers, stack = {}, [], Open()
    for i, tag in enumerate(found):
        name = tag.name
        if name in VOID_TAGS or not (name in BLOCK_TAGS or name in SILENT_TAGS):
            continue
        last = stack.last(name)
        if tag.closing:
            if last >= 0:
                if name in SILENT_TAGS:
                    out[numbers[last]] = i
                stack.cut(last)
        elif not tag.empty:
            if name in ("option", "button") and last >= 0:  # these end one of their kind
                stack.cut(last)
            stack.push(Part(name))
        del numbers[len(stack.parts) :]
        if not tag.closing and len(numbers) < len(stack.parts):
            numbers.append(i)
    return out


def named(attrs: dict[str, str]) -> tuple[bool, bool, bool, bool]:
    """What attributes say of a part: hidden, a strong name, a weak name, a good name."""
    if not attrs:
        return False, False, False, False
    hidden = "hidden" in attrs or bool(_HIDDEN.search(attrs.get("style", "")))
    role = attrs.get("role", "").lower()
    strong, weak, good = role in BAD_ROLES, False, role in GOOD_TAGS
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = _NAME.findall(token)
        if words and words[0].lower() not in MODIFIERS:
            for word in (words[0].lower(), words[-1].lower()):
                strong |= word in STRONG_NAMES
                weak |= word in WEAK_NAMES
                good |= word in GOOD_NAMES
    return hidden, strong, weak, good


@dataclass(slots=True)
class Block:
    """A text block. bad: hidden, or in a part that is not the article's; group: the part within which its neighbours count."""

    text: str
    part: Part | None
    heading: bool
    words: int
    stops: int
    linked: int
    bad: bool = False
    weak: bool = False
    main: bool = False
    group: object = None


def settle_parts(parts: list[Part], found: list[Block]) -> None:
    """Sets bad, weak, main and group of the blocks. parts come in the order in which they were opened."""
    total = articles = 0
    for b in found:
        p = b.part
        if p is None or not p.hard:
            total += len(b.text)
            articles += len(b.text) * (p is not None and p.inside)
            if p is not None:
                p.chars += len(b.text)
                p.article_chars += len(b.text) * p.inside
    for p in reversed(parts):
        if p.parent is not None:
            p.parent.chars += p.chars
            p.parent.article_chars += p.article_chars
    state: dict[int, tuple[bool, bool, bool, Part | None]] = {}
    for p in parts:
        bad, weak, main, lowest = state[id(p.parent)] if p.parent is not None else (False, False, False, None)
        kept = p.article or (2 * p.article_chars > articles if articles else 2 * p.chars > total)
        strong = p.hard or p.strong and not kept
        if p.weak and not kept:
            weak, lowest = True, p
        state[id(p)] = (bad or strong, weak, main or p.main and not strong, lowest)
    for b in found:
        b.bad, b.weak, b.main, part = state[id(b.part)] if b.part is not None else (False, False, False, None)
        b.group = id(part) if part is not None else b.main


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Unclosed elements end with the part around them."""
    out: list[Block] = []
    parts: list[Part] = []
    found, stack = list(tags(page)), Open()
    ends = silent_ends(found)
    text: list[str] = []
    linked = at = i = 0
    link_depth = -1  # of the open elements around a link that is open

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                words = whole.lower().split()
                stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words)
                out.append(Block(whole, stack.parts[-1] if stack.parts else None, any(stack.last(h) >= 0 for h in HEADINGS), len(words), stops, min(linked, len(whole))))
            text.clear()
        linked = 0

    while i <= len(found):
        stop = found[i].start if i < len(found) else len(page)
        if stop > at and not stack.silent:
            piece = page[at:stop]
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if link_depth >= 0:
                linked += len(piece.strip())
        if i == len(found):
            break
        tag, number = found[i], i
        i, at, name = i + 1, tag.end, tag.name
        if not name:
            continue
        if tag.closing:
            if name in BLOCK_TAGS:
                end_block()
            if name == "a":
                link_depth = -1
            if (last := stack.last(name)) >= 0:
                stack.cut(last)
        else:
            if name in BLOCK_TAGS:
                end_block()
                if stack.silent and name not in ("option", "optgroup"):  # what has no end tag ends here at last
                    stack.cut(stack.silent[0])
            if name in SELF_ENDING:
                stack.end_own_kind(name)
        if len(stack.parts) < link_depth:  # a link without an end ends with the part around it
            link_depth = -1
        if tag.closing:
            continue
        if name in VOID_TAGS:
            if name == "br":
                text.append(" ")
            continue
        if name in SILENT_TAGS:
            if number in ends:
                i = ends[number] + 1
                at = found[i - 1].end
                continue
            if tag.empty:
                continue
        if name == "a" and "href" in tag.attrs:
            link_depth = len(stack.parts)
        hidden, strong, weak, good = named(tag.attrs) if name not in ("html", "body") else (False, False, False, False)
        if name not in BLOCK_TAGS and name not in SILENT_TAGS and not (hidden or strong or weak):
            continue
        around = stack.parts[-1] if stack.parts else None
        article = name in GOOD_TAGS and not hidden and (name == "main" or good or not (strong or weak))
        inside = article or around is not None and around.inside
        loose = name == "form" or name == "header" and not inside
        hard = hidden or name in BAD_TAGS or around is not None and around.hard
        part = Part(name, around, hidden, hard, strong or loose, weak, article, not hard and (name in GOOD_TAGS and article or good and not (strong or weak) and name in BLOCK_TAGS), name in SILENT_TAGS, inside)
        parts.append(part)
        stack.push(part)
    end_block()
    settle_parts(parts, out)
    return out


def label(b: Block) -> str:
    """Pass one: good and bad are decided; near (some evidence) and short are ambiguous."""
    density, links = b.stops / b.words, b.linked / len(b.text)
    if b.bad:
        return "bad"
    if b.heading or len(b.text) < SHORT:
        return "bad" if (b.weak and (links > LINK_LIMIT or not b.main)) or (b.linked and not b.main) else "short"
    score = (density >= STOP_HIGH) + (density >= STOP_LOW) - 2 * (links > LINK_LIMIT) + b.main - 2 * b.weak
    if score >= 1:
        return "good" if score >= 2 else "near"
    return "short" if b.main and not (b.weak and links > LINK_LIMIT) else "bad"


def kept(found: list[Block]) -> list[bool]:
    """Pass two: which blocks stay.

    An ambiguous block looks at the nearest decided blocks before and after it in its own group: it takes the
    label that they share, or else that of the nearer one, the first if both are as near; a near one stays beside
    any good one. Without decided neighbours it stays if it is in the article, or if the page marks none.
    """
    labels = [label(b) for b in found]
    marked = any(b.main and not b.bad for b in found)

    def nearest(order) -> list[tuple[int, bool] | None]:
        seen: dict = {}
        out: list = [None] * len(found)
        for i in order:
            out[i] = seen.get(found[i].group)
            if labels[i] in ("good", "bad") and not found[i].bad:
                seen[found[i].group] = (i, labels[i] == "good")
            elif found[i].bad:
                seen[False] = (i, False)
        return out

    befores, afters = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    out = []
    for i, (b, mark, before, after) in enumerate(zip(found, labels, befores, afters, strict=True)):
        if mark in ("good", "bad"):
            out.append(mark == "good")
        elif before is None and after is None:
            out.append(b.main or not marked and not b.weak)
        elif mark == "near":
            out.append(any(x is not None and x[1] for x in (before, after)))
        else:
            nearer = before if after is None or before is not None and i - before[0] <= after[0] - i else after
            out.append(nearer[1])
    return out


def main_text(page: str) -> str:
    """The blocks that stay, joined by a line feed."""
    found = blocks(page)
    return "\n".join(b.text for b, stays in zip(found, kept(found), strict=True) if stays)


def extract_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """keys, text and n_chars of every page, a row per row; other columns are left out.

    A null or empty page, or one without a good block, has an empty text. Equal pages give equal texts. Every
    page is handled where it is read, without a shuffle.
    """
    kinds = ", ".join(f"k{i} {pages.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    columns = pages.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.coalesce(page, F.lit("")).alias("page"))

    def row(*values):
        text = main_text(values[-1])
        return (*values[:-1], text, len(text))

    found = map_rows(columns, row, f"{kinds}, text string, n_chars long")
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "text", "n_chars")
