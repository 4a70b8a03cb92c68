"""Selector hits of one page: the small helper that runs inside the parse tasks.

Spark has no HTML expression (its ``xpath_*`` functions need well-formed XML and
abort on ``<br>``), so this one step is Python.  It walks the markup once, keeps a
stack of open elements and notes which elements match the requested selectors.
Everything that is decided *about* the hits is done later by Catalyst.

Selector grammar: ``tag``, ``.class``, ``tag.class``, ``[attr]``, ``[attr*="s"]`` and
the descendant blank.  Nothing else is needed and nothing else is supported.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterator
from typing import NamedTuple
from urllib.parse import urljoin

MARKUP = re.compile(
    r"<(?:(!--)"
    r"|(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|[!?/][^>]*+>)"
)
LEFT_OPEN = re.compile("<[!?/]")
ATTRIBUTE = re.compile(
    r"""([^\s=/"'][^\s=/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s]*)))?"""
)
UNQUOTED_TAIL = re.compile(r"""=\s*[^\s"'][^\s]*\Z""")
REFERENCE = re.compile(r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)")
# References that need no resolving: no dots or doubled slashes in the path, no parameters.
PLAIN_PATH = re.compile(r"(?:/[\w%-]+)+/?(?:\?[\w%=&-]+)?", re.ASCII)
PLAIN_ADDRESS = re.compile(r"https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*" + PLAIN_PATH.pattern, re.ASCII)
SITE_ROOT = re.compile(r"https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*(?=[/?#]|\Z)", re.ASCII)
COMPOUND = re.compile(r"([\w-]*)((?:\.[\w-]+)*)((?:\[[^\]]+\])*)\Z")
ATTRIBUTE_TEST = re.compile(r'\[([\w-]+)(?:\*="([^"]*)")?\]')
DIGIT = re.compile("[0-9]")
CLASS_WORD = re.compile("class", re.IGNORECASE)
NOTHING = ()
ASCII_BLANKS = " \n\t\f\r"

# Public facts about HTML, not catalog values: elements without content, raw-text
# elements, elements whose strings are not page text, and which open elements a new
# start tag ends (the usual tag-soup repairs).
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style"))
NOT_TEXT = frozenset(("script", "style", "template"))
BLOCKS = (
    "address blockquote center dd dir div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li menu ol p pre "
    "table tbody td tfoot th tr ul"
).split()
ENDS = {tag: {"p", "head"} for tag in BLOCKS}
ENDS["body"] = {"head", "title", "style", "p"}
for _tag, _open in {
    "a": "a head",
    "li": "li h1 h2 h3 h4 h5 h6",
    "dt": "dt dd",
    "dd": "dt dd",
    "option": "option",
    "optgroup": "option",
    "td": "td th a b span",
    "th": "td th a b span",
    "tr": "td th tr",
    "tbody": "td th tr thead tbody",
    "tfoot": "td th tr thead tbody",
    "table": "a h1 h2 h3 h4 h5 h6",
    "form": "h1 h2 h3 h4 h5 h6",
    "p": "b big small u tt h1 h2 h3 h4 h5 h6",
    "img": "head",
    "span": "head",
}.items():
    ENDS.setdefault(_tag, set()).update(_open.split())
# Fields whose value is an address: the attributes to read it from, in order.
REFERENCES = {"link": ("href",), "image": ("src", "data-src")}
# An end tag does not reach across an open element of higher rank.
RANK = {"div": 2, "td": 3, "th": 3, "tr": 4, "thead": 5, "tbody": 5, "tfoot": 5,
        "table": 6, "head": 7, "body": 7, "html": 8}
BARRIERS = {rank: [t for t in RANK if RANK[t] > rank] for rank in range(1, 9)}


class Step(NamedTuple):
    """One compound of a selector, e.g. the ``a[href]`` of ``.product a[href]``."""

    field: str
    rank: int
    tag: str
    classes: tuple
    attributes: tuple
    needs: int   # bit an ancestor must have set, 0 for the first compound
    gives: int   # bit this element sets for its descendants, 0 for the last compound


class Matcher:
    """Selectors of the requested fields, indexed by the class, tag or attribute they name."""

    def __init__(self, selectors: dict[str, tuple[str, ...]], takes: dict[str, int | None]):
        self.takes = takes
        self.by_class: dict[str, list[Step]] = {}
        self.by_tag: dict[str, list[Step]] = {}
        self.by_attribute: dict[str, list[Step]] = {}
        bit = 1
        for field, ranked in selectors.items():
            for rank, selector in enumerate(ranked):
                compounds = selector.split()
                needs = 0
                for index, compound in enumerate(compounds):
                    parsed = COMPOUND.match(compound)
                    if not parsed:
                        raise ValueError(f"selector outside the supported grammar: {selector!r}")
                    gives = 0
                    if index < len(compounds) - 1:
                        gives, bit = bit, bit << 1
                    tag, classes, tests = parsed.groups()
                    step = Step(field, rank, tag, tuple(filter(None, classes.split("."))),
                                tuple(ATTRIBUTE_TEST.findall(tests)), needs, gives)
                    if step.classes:
                        self.by_class.setdefault(step.classes[0], []).append(step)
                    elif tag:
                        self.by_tag.setdefault(tag, []).append(step)
                    else:
                        self.by_attribute.setdefault(step.attributes[0][0], []).append(step)
                    needs = gives
        self.named = re.compile("|".join(map(re.escape, self.by_attribute)), re.IGNORECASE)

    def wants(self, tag: str, source: str) -> bool:
        """Whether the attributes of this start tag can matter at all."""
        return (tag in self.by_tag or tag == "script" or CLASS_WORD.search(source) is not None
                or bool(self.by_attribute) and self.named.search(source) is not None)

    def steps(self, tag: str, attributes: dict, classes: Collection[str], bits: int) -> list[Step]:
        """Steps this element completes, given the bits its ancestors have set."""
        candidates = list(self.by_tag.get(tag, ()))
        for name in classes:
            candidates += self.by_class.get(name, ())
        if self.by_attribute:
            for name in attributes:
                candidates += self.by_attribute.get(name, ())
        found = []
        for step in candidates:
            if step.needs and not bits & step.needs or step.tag and step.tag != tag:
                continue
            if len(step.classes) > 1 and not set(step.classes).issubset(classes):
                continue
            for name, part in step.attributes:
                if part not in attributes.get(name, NOTHING):
                    break
            else:
                found.append(step)
        return found


def decode(text: str) -> str:
    return REFERENCE.sub(lambda m: html_lib.unescape(m[0]), text) if "&" in text else text


def absolute(url: str, reference: str) -> str:
    """``urljoin``, with short cuts for the two forms nearly all references have."""
    if PLAIN_ADDRESS.fullmatch(reference):
        return reference
    root = SITE_ROOT.match(url)
    if root and PLAIN_PATH.fullmatch(reference):
        return root[0] + reference
    return urljoin(url, reference)


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), decode(double or single or bare))
    return found


class PageHits:
    """What one page yields: flags, text and, per field, ``(rank, ord, area, value)`` hits.

    The texts of hits may contain each other, so a hit keeps where its text begins and ends in one
    buffer of the page, ``glued``; texts are cut out when they are asked for.
    """

    __slots__ = ("has_title", "text", "text_len", "jsonld", "spans", "glued", "area")

    def __init__(self, html: str, url: str, matcher: Matcher, jsonld_type: str):
        self.has_title = False
        self.jsonld: list[str] = []
        self.spans: dict[str, list] = {field: [] for field in matcher.takes}
        self.area = None
        self._walk(html, url, matcher, jsonld_type)

    def found(self, field: str) -> Iterator[list]:
        """Hits of a field by rank and order, each with its whole text or its address."""
        for rank, order, areas, value in self.spans[field]:
            yield [rank, order, areas, value if field in REFERENCES else self.glued[value[0]:value[1]]]

    @property
    def hits(self) -> dict[str, list]:
        return {field: list(self.found(field)) for field in self.spans}

    def amounts(self, field: str, marks: tuple[str, ...]) -> Iterator[list]:
        """Hits of a field, each with the part of its text that decides about an amount.

        That is the first of ``marks`` the text contains, if any, and what follows from its first digit on for as long as it may
        belong to the number: digits, points, commas and letters of the marks.  Found from places noted in one pass, so
        thousands of elements inside each other cost no more than as many side by side.
        """
        spans = self.spans[field]
        if not spans:
            return
        low, high = min(hit[3][0] for hit in spans), max(hit[3][1] for hit in spans)
        places = [(mark, [m.start() for m in re.finditer(re.escape(mark), self.glued[low:high])]) for mark in marks]
        inside = re.escape("".join(sorted(set("".join(marks)))))
        runs = [m.span() for m in re.finditer(f"[0-9][0-9.,{inside}]*", self.glued[low:high])]
        ends = [end for _, end in runs]
        for rank, order, areas, (start, end) in spans:
            mark = next((mark for mark, at in places if (k := bisect_left(at, start - low)) < len(at)
                         and at[k] + len(mark) <= end - low), "")
            number = ""
            for k in range(bisect_right(ends, start - low), len(runs)):
                first, last = max(runs[k][0] + low, start), min(runs[k][1] + low, end)
                digit = DIGIT.search(self.glued, first, last) if first < last else None
                if digit:
                    number = self.glued[digit.start():last]
                if digit or first >= end:
                    break
            yield [rank, order, areas, mark + number]

    def _walk(self, html: str, url: str, matcher: Matcher, jsonld_type: str) -> None:
        stack: list[tuple] = []      # (tag, selector bits, area bits, hits waiting for their text)
        buffer: list[str] = []       # pieces of the current text node
        nodes: list[str] = []        # all text nodes, as they are
        stripped: list[str] = []     # the same nodes stripped, empties left out
        filled = 0                   # their length so far
        opened: dict[str, list[int]] = {}  # where in the stack each tag is open
        counts: dict[tuple, int] = {}
        joined: dict[str, str] = {}  # references made absolute
        hidden = 0                   # open elements whose strings are not page text

        def end_node() -> None:
            nonlocal filled
            node = decode("".join(buffer))
            buffer.clear()
            if hidden or not stack and not node.strip():
                return
            bare = node.strip()
            if bare:
                stripped.append(bare)
                filled += len(bare)
            elif not node.strip(ASCII_BLANKS):
                node = "\n" if "\n" in node else " "
            nodes.append(node)

        def close(depth: int) -> None:
            nonlocal hidden
            while len(stack) > depth:
                tag, _, _, waiting = stack.pop()
                opened[tag].pop()
                if tag in NOT_TEXT:
                    hidden -= 1
                for hit in waiting:
                    hit[3] = (hit[3], filled)

        position, size = 0, len(html)
        # No tag can end behind the last ">"; without that bound each unclosed tag would be
        # searched to the end of the page.
        last = html.rfind(">") + 1
        tokens = MARKUP.finditer(html, 0, last)
        while True:
            token = next(tokens, None)
            if token is None:
                left_open = LEFT_OPEN.search(html, max(position, last))
                if position < size:
                    buffer.append(html[position:left_open.start() if left_open else size])
                break
            start, after = token.span()
            if start > position:
                buffer.append(html[position:start])
            position = after
            comment, ending, tag, source = token.groups()
            if tag is None:
                if buffer:
                    end_node()
                if comment:
                    finish = html.find("-->", position)
                    position = finish + 3 if finish >= 0 else size
                    tokens = MARKUP.finditer(html, position, last)
                continue
            tag = tag.lower()

            if ending:
                if opened.get(tag):
                    depth = opened[tag][-1]
                    if depth == len(stack) - 1 or not any(
                            opened.get(t) and opened[t][-1] > depth for t in BARRIERS[RANK.get(tag, 1)]):
                        if buffer:
                            end_node()
                        close(depth)
                continue

            if buffer:
                end_node()
            ends = ENDS.get(tag)
            if ends:
                while stack and stack[-1][0] in ends:
                    close(len(stack) - 1)
            if tag == "title":
                self.has_title = True
            bits, areas = stack[-1][1:3] if stack else (0, 0)
            own_bits, own_areas, waiting = bits, areas, NOTHING
            attributes = attributes_of(source) if source and matcher.wants(tag, source) else {}
            if attributes or tag in matcher.by_tag:
                classes = set(attributes["class"].split()) if "class" in attributes else NOTHING
                for step in matcher.steps(tag, attributes, classes, bits):
                    if step.gives:
                        own_bits |= step.gives
                        continue
                    count = counts.get((step.field, step.rank), 0) + 1
                    counts[step.field, step.rank] = count
                    if step.field == "area":
                        if count == 1:
                            own_areas |= 1 << step.rank
                            self.area = step.rank if self.area is None else min(self.area, step.rank)
                        continue
                    take = matcher.takes[step.field]
                    if take is not None and count > take:
                        continue
                    if step.field in REFERENCES:
                        names = REFERENCES[step.field]
                        reference = next(filter(None, map(attributes.get, names)), None)
                        if reference is None:
                            continue
                        if reference not in joined:
                            try:
                                joined[reference] = absolute(url, reference)
                            except ValueError:  # a malformed address: the hit stays, without one
                                joined[reference] = None
                        hit = [step.rank, count, areas, joined[reference]]
                    else:
                        hit = [step.rank, count, areas, filled]
                        waiting = [*waiting, hit]
                    self.spans[step.field].append(hit)

            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, own_bits, own_areas, waiting))
            if tag in NOT_TEXT:
                hidden += 1
            if tag in VOID or source.endswith("/") and not UNQUOTED_TAIL.search(source):
                close(len(stack) - 1)
            elif tag in RAW_TEXT:
                finish = _raw_end(html, position, tag)
                if tag == "script" and attributes.get("type") == jsonld_type and finish > position:
                    self.jsonld.append(html[position:finish])
                position = finish
                tokens = MARKUP.finditer(html, position, last)

        if buffer:
            end_node()
        close(0)
        self.text = "".join(nodes)
        self.text_len = len(self.text)
        self.glued = "".join(stripped)
        for found in self.spans.values():
            found.sort(key=lambda hit: (hit[0], hit[1]))


def _raw_end(html: str, position: int, tag: str) -> int:
    width = len(tag) + 2
    while True:
        position = html.find("</", position)
        if position < 0:
            return len(html)
        if html[position + 2:position + width].lower() == tag:
            return position
        position += 2
