"""A page's article, read in Python from its elements: body rules by platform and by markup, which patterns cannot follow
through nested elements. A page is read once into flat lists, so no depth of nesting is a problem."""

from __future__ import annotations

import json
import re
from collections import Counter
from urllib.parse import quote, urldefrag, urljoin, urlsplit

from .markup import CLOSES_P, RAW, SPECIAL, VOID, attributes, decoded, tokens

#: Fixed patterns of the sites with body rules of their own.
PLATFORMS = {
    "wechat": re.compile(r"^https?://mp\.weixin\.qq\.com/s/", re.I),
    "bbc": re.compile(r"^https?://www\.bbc\.com/news/articles/", re.I),
    "cnn": re.compile(r"^https?://(?:edition\.|www\.)?cnn\.com/[0-9]{4}/[0-9]{2}/[0-9]{2}/", re.I),
    "netease": re.compile(r"^https?://www\.163\.com/(?:news|dy)/article/", re.I),
}
PLATFORM_BODIES = {"wechat": ["#js_content"], "bbc": ["article text-block", "article"], "cnn": ["main"], "netease": ["div.post_body"]}
BODIES = ["article", "main[role]", "main", "[itemprop]", ".article-body", ".article-content", ".post-content", ".entry-content", "*article-body", "*article-content"]
DROPPED = {"script", "style", "noscript", "template"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})}
SIBLINGS |= {t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")} | {"tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"})}
_SPACE = re.compile(r"[\s\ufeff]+")


def _clean(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip(" ")


class Node:
    __slots__ = ("tag", "attrs", "text", "until", "at", "last")

    def __init__(self, tag: str, attrs: dict, text: int, at: int):
        self.tag, self.attrs, self.text, self.at = tag, attrs, text, at
        self.until, self.last = text, at + 1  # ends of its texts and of its elements


class Page:
    """``nodes`` and ``texts`` in the order of the page, without scripts and the like; ``data``: the texts of JSON-LD.

    What is open is counted by kind, so that no tag has to look through all open elements, however deep they are."""

    def __init__(self, html: str):
        self.nodes, self.texts, self.data, self.open, self.first = [], [], [], [], {}
        self.count, self.plain = Counter(), [Counter()]  # by tag; of those that are not special, since each special one
        self.paragraphs, self.bars, self.credits = [], [], []  # where open elements of these kinds stand
        for kind, value, behind in tokens(html):
            if kind == "start":
                self._start(value, attributes(behind) if behind else {})
            elif kind == "end":
                self._close(value)
            else:
                self._text(value, kind == "raw")
        self._end(0)

    def _begin(self, node: Node) -> None:
        at, tag = len(self.open), node.tag
        self.open.append(node)
        self.count[tag] += 1
        if tag in SPECIAL:
            self.plain.append(Counter())
        else:
            self.plain[-1][tag] += 1
        if tag == "p":
            self.paragraphs.append(at)
        if tag in ("button", "td", "th", "table", "caption", "object", "template"):
            self.bars.append(at)
        if node.attrs.get("rel") == "author":
            self.credits.append((at, "[rel] a"))
        elif node.attrs.get("data-component") == "byline-block":
            self.credits.append((at, "byline-block a"))

    def _end(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            node.until, node.last = len(self.texts), len(self.nodes)
            self.count[node.tag] -= 1
            if node.tag in SPECIAL:
                self.plain.pop()
            else:
                self.plain[-1][node.tag] -= 1
        for marks in (self.paragraphs, self.bars):
            while marks and marks[-1] >= depth:
                marks.pop()
        while self.credits and self.credits[-1][0] >= depth:
            self.credits.pop()

    def _dropped(self) -> bool:
        return any(self.count[t] for t in DROPPED)

    def _start(self, tag: str, found: dict[str, str]) -> None:
        if tag in CLOSES_P and self.paragraphs and self.paragraphs[-1] > (self.bars or [-1])[-1]:
            self._end(self.paragraphs[-1])
        if tag in SIBLINGS:
            same, outer = SIBLINGS[tag]
            if any(self.count[t] for t in same):
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i].tag in same:
                        self._end(i)
                        break
                    if self.open[i].tag in outer:
                        break
        if tag == "a":
            self._close("a")
        node = Node(tag, found, len(self.texts), len(self.nodes))
        if not self._dropped() and tag not in DROPPED:
            self.nodes.append(node)
            self._select(node)
        if tag not in VOID:
            self._begin(node)

    def _close(self, tag: str) -> None:
        if not (self.count[tag] if tag in SPECIAL | DROPPED else self.plain[-1][tag]):
            return
        i = len(self.open) - 1
        while self.open[i].tag != tag:
            i -= 1
        self._end(i)

    def _text(self, data: str, raw: bool) -> None:
        inner = self.open[-1].tag if self.open else ""
        if raw and inner == "script":
            if self.open[-1].attrs.get("type", "").strip().lower() == "application/ld+json":
                self.data.append(data)
        elif not self._dropped():
            self.texts.append(data if raw and inner in RAW - {"title", "textarea"} else decoded(data))

    def _select(self, node: Node) -> None:
        tag, a = node.tag, node.attrs
        kinds, names = a.get("class", "").split(), [tag]
        names += [f".{k}" for k in kinds if k in ("article-body", "article-content", "post-content", "entry-content", "byline")]
        names += [f"*{k}" for k in ("article-body", "article-content") if k in a.get("class", "")]
        if tag == "main" and a.get("role") == "main":
            names.append("main[role]")
        if a.get("itemprop") == "articleBody":
            names.append("[itemprop]")
        if a.get("id") in ("js_content", "activity-name"):
            names.append(f"#{a['id']}")
        if tag == "div" and "post_body" in kinds:
            names.append("div.post_body")
        if tag == "div" and a.get("data-component") == "text-block" and self.count["article"]:
            names.append("article text-block")
        if a.get("data-component") == "byline-block":
            names.append("byline-block")
        if a.get("rel") == "author":
            names.append("[rel]")
        if tag == "time" and "datetime" in a:
            names.append("time[datetime]")
        if tag == "meta":
            names += [f"meta {a[k]}" for k in ("name", "property") if k in a]
        if tag == "a":
            names += dict.fromkeys(name for _, name in self.credits)
        for x in names:
            self.first.setdefault(x, node)

    def within(self, node: Node) -> list[Node]:
        return self.nodes[node.at + 1 : node.last]

    def text(self, node: Node) -> str:
        return _clean("".join(self.texts[node.text : node.until]))

    def first_text(self, *names: str) -> str:
        return next((t for x in names if x in self.first and (t := self.text(self.first[x]))), "")

    def first_attribute(self, key: str, *names: str) -> str:
        return next((t for x in names if x in self.first and (t := _clean(self.first[x].attrs.get(key)))), "")

    def score(self, name: str) -> tuple[float, int]:
        """(score, length of the text) of what a body rule finds."""
        node = self.first.get(name)
        if node is None:
            return 0.0, 0
        inner, n = self.within(node), len(self.text(node))
        linked = len(_clean("".join("".join(self.texts[x.text : x.until]) for x in inner if x.tag == "a")))
        return n + 180 * sum(x.tag == "p" for x in inner) - 0.35 * min(linked, n), n


def _address(value: str, base: str) -> str:
    """A link's address without fragment; what is no address stays as it is."""
    try:
        full = urldefrag(urljoin(base, value.strip()))[0]
        parts = urlsplit(full)
        if parts.scheme not in ("http", "https"):
            return full
        return quote(parts._replace(netloc=parts.netloc.lower(), path=parts.path or "/").geturl(), safe="%/:=&?~+!$,;'@()*[]|")
    except ValueError:
        return value.strip()


def _contents(page: Page, root: Node, base: str) -> list[dict]:
    found = {}

    def put(kind: str, content: str, desc: str) -> None:
        if content:
            found.setdefault((kind, content), {"type": kind, "content": content, "desc": desc})

    for node in page.within(root):
        tag, a = node.tag, node.attrs
        if tag == "img":
            source = a.get("src") or a.get("data-src") or a.get("data-original")
            if source:
                put("image", _address(source, base), _clean(a.get("alt") or source))
        elif tag in ("video", "iframe"):
            source = a.get("src") or next((x.attrs.get("src") for x in page.within(node) if x.tag == "source"), None)
            if source:
                put("video", _address(source, base), source)
        elif tag in ("p", "h2", "h3", "li", "blockquote") and not (tag == "li" and any(x.tag == "p" for x in page.within(node))):
            text = page.text(node)
            put("text", text and {"h2": "## ", "h3": "## ", "li": "• "}.get(tag, "") + text, text)
    if not found:
        put("text", page.text(root), page.text(root))
    return list(found.values())


def _records(page: Page) -> list[dict]:
    found = []
    for text in page.data:
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            continue  # the other ways remain
        found += [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
    return found


def _of_records(records: list[dict], *keys: str) -> str:
    for record in records:
        for key in keys:
            value = record.get(key)
            value = value[0] if isinstance(value, list) and value else value
            value = value.get("name") if isinstance(value, dict) and key == "author" else value
            if isinstance(value, str) and _clean(value):
                return _clean(value)
    return ""


ARTICLE = (
    "url string, title string, publish_time string, author string, author_url string, contents array<struct<type:string,content:string,desc:string>>, "
    "platform string, method string, confidence double, warnings array<string>"
)


def read_article(url: str | None, html: str | None, least: int) -> dict | None:
    """The fields of ``ARTICLE``, or none where no rule finds a title and ``least`` characters of body."""
    if not html:
        return None
    page, url = Page(html), url or ""
    platform = next((k for k, p in PLATFORMS.items() if p.search(url)), None)
    own = next((x for x in PLATFORM_BODIES.get(platform, []) if page.score(x)[1] >= least), None)
    best = own
    if best is None:
        scored = [(*page.score(x), x) for x in BODIES]
        best = max((s for s in scored if s[1] >= least), key=lambda s: s[0], default=(0, 0, None))[2]  # the first of equals
    records = _records(page)
    title = _of_records(records, "headline", "name") or page.first_attribute("content", "meta og:title", "meta twitter:title")
    title = title or page.first_text(*(["#activity-name"] if platform == "wechat" else []), "h1", "title")
    contents = _contents(page, page.first[best], url) if best else []
    if not title or not contents:
        return None
    times = "meta article:published_time", "meta datePublished", "time[datetime]"
    time = _of_records(records, "datePublished", "dateCreated") or page.first_attribute("content", *times) or page.first_attribute("datetime", "time[datetime]") or page.first_text("time")
    author = _of_records(records, "author") or page.first_attribute("content", "meta author") or page.first_text("[rel]", "byline-block", ".byline")
    link = page.first_attribute("href", "[rel] a", "byline-block a")
    return {
        "url": url, "title": title, "publish_time": time or None, "author": author or None, "author_url": _address(link, url) if link else None, "contents": contents, "platform": platform,
        "method": "platform-rule" if own else "generic-rule", "confidence": 0.95 if own else 0.65, "warnings": [] if time else ["publish_time_not_found"],
    }
