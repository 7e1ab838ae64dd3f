"""Web pages as sequences of leaf blocks: runs of text between block-level tags, with the path of tags above."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")

#: Their content is not text.
RAW = frozenset({"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title", "select", "math", "canvas", "audio", "video"})
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag of the same group ends.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Element:
    """A path of elements: its last step (tag, then words of class, id and role) and the path around it. Equal paths are
    one object, so a page takes memory for its distinct paths and not for the steps above each of its blocks."""

    __slots__ = ("above", "depth", "inner", "marks", "step", "tag")

    def __init__(self, step: str, above: Element | None):
        self.step, self.above, self.tag = step, above, step.split(" ", 1)[0]
        self.depth = 1 + (above.depth if above else 0)
        self.inner: dict[str, Element] = {}
        self.marks: dict = {}  # what users of the path have found out for it

    def within(self, step: str) -> Element:
        found = self.inner.get(step)
        if found is None:
            found = self.inner[step] = Element(step, self if self.step else None)
            _made[0] += 1
        return found

    @staticmethod
    def of(path: tuple[str, ...]) -> Element | None:
        at = _root[0]
        for step in path:
            at = at.within(step)
        return at if path else None


#: Paths are shared by the pages of a process, until there are ``MOST_PATHS`` of them.
MOST_PATHS = 20_000
_root, _made = [Element("", None)], [0]


@dataclass
class Block:
    """A leaf: its text, the innermost element it lies in and the share of it inside links."""

    text: str
    at: Element | None
    linked: float

    @property
    def path(self) -> tuple[str, ...]:
        steps, at = [], self.at
        while at:
            steps.append(at.step)
            at = at.above
        return tuple(reversed(steps))


def _step(tag: str, attrs: str) -> str:
    if not attrs or "=" not in attrs:
        return tag
    names = [w.lower() for m in _NAMES.finditer(attrs) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")]
    return " ".join([tag, *names])


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Unclosed, misnested and unknown tags are taken as a browser roughly does."""
    if _made[0] > MOST_PATHS:
        _root[0], _made[0] = Element("", None), 0
    out: list[Block] = []
    stack: list[Element] = []
    where: dict[str, list[int]] = defaultdict(list)  # the places of each open tag in the stack
    parts: list[str] = []
    links = [0, 0]  # depth of <a>, characters inside

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(1.0, links[1] / len(text))))
            parts.clear()
        links[1] = 0

    def put(raw: str) -> None:
        if raw:
            parts.append(raw)
            if links[0]:
                links[1] += len(raw)

    def pop_to(tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        last = lambda names: max((where[t][-1] for t in names if where.get(t)), default=-1)
        k = last(tags)
        if k > last(stops):
            for e in stack[k:]:
                where[e.tag].pop()
            del stack[k:]

    # Beyond the last > there is no markup, so that no < is followed to the end of the page in vain.
    at, size, final = 0, len(page), page.rfind(">") + 1
    while at < size:
        m = _MARKUP.search(page, at, final) if at < final else None
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        ending = bool(m["end"] or m["end2"])
        if tag in RAW:
            if not ending and not (m["attrs"] or m["attrs2"] or "").rstrip().endswith("/"):
                close()
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else size
            continue
        if tag in INLINE:
            if tag == "a":
                links[0] = 0 if ending else 1
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        links[0] = 0
        if ending:
            pop_to((tag,), ())
            continue
        pop_to(("p",), ("div", "article", "section", "td", "li", "body"))
        if tag in _ENDS:
            pop_to(_ENDS[tag], ("ul", "ol", "dl", "table"))
        if tag not in VOID:
            where[tag].append(len(stack))
            stack.append((stack[-1] if stack else _root[0]).within(_step(tag, m["attrs"] or m["attrs2"] or "")))
    close()
    return out
