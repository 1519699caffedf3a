"""A small tolerant reader of HTML: block elements as a tree, and their texts in page order."""

from __future__ import annotations

import html
import re
from collections import Counter

#: Elements by kind; fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video title textarea select head".split())
UNREAD = RAW - {"head", "object", "audio", "video", "canvas", "svg", "math", "noscript", "template", "select"}  # their content is not markup
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small strike strong sub sup time tt u var".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: A tag ends before the next "<", and nothing is matched twice, so broken markup is read in linear time.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*"|'[^']*'|[^<>"'])*+)>|<[!?][^<>]*+>|([^<]++|<)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")


class Page:
    """Nodes in page order (a parent before its children); ``stream`` holds (node, text) and breaks (node, None)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens = ["#root"], [-1], [0], [frozenset()]
        self.own, self.linked = [0], [0]  # characters of text, and of those in links
        self.stream: list[tuple[int, str | None]] = []
        self.open: Counter[str] = Counter()  # tags on the stack, so that deep pages need no search through it
        stack, links, at = [0], 0, 0
        while at < len(source):
            m = TOKEN.match(source, at)
            at = m.end()
            text, name = m[4], m[2]
            if text is not None:
                if "&" in text:
                    text = html.unescape(text)
                node, n = stack[-1], len(text) - text.count(" ") if text.strip() else 0
                self.own[node] += n
                if links:
                    self.linked[node] += n
                self.stream.append((node, text))
                continue
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                if name == "br" or name == "p" and not self.open["p"]:
                    self.stream.append((stack[-1], None))
                for depth in range(len(stack) - 1, 0, -1) if self.open[name] else ():
                    if self.tag[stack[depth]] == name:
                        if name != "span":
                            self.stream.append((stack[-1], None))
                        self._end(stack, depth)
                        break
                continue
            if name in UNREAD or name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                if end or name != "head":
                    at = end.end() if end else len(source) if name in UNREAD else at
                    continue
            if name == "br" or name in VOID:
                if name in ("br", "hr"):
                    self.stream.append((stack[-1], None))
                continue
            if name in INLINE:
                links += name == "a"
                continue
            marks = frozenset(p.lower() for a in ATTRIBUTE.finditer(m[3]) for p in PART.findall(a[2] or a[3] or a[4] or "")) if m[3] else frozenset()
            if name == "span" and not marks:
                continue
            if name != "span":
                self._close(name, stack)
                links = 0
            self.stream.append((stack[-1], None)) if name != "span" else None
            stack.append(len(self.tag))
            self.tag.append(name)
            self.open[name] += 1
            self.parent.append(stack[-2])
            self.depth.append(len(stack) - 1)
            self.tokens.append(marks)
            self.own.append(0)
            self.linked.append(0)

    def _end(self, stack: list[int], depth: int) -> None:
        self.open.subtract(self.tag[s] for s in stack[depth:])
        del stack[depth:]

    def _close(self, name: str, stack: list[int]) -> None:
        """End the elements that a start tag ends without saying so."""
        ends, holds = CLOSES.get(name, set()), HOLDS.get(name, set())
        if not self.open["p"] and not any(self.open[t] for t in ends):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in holds or tag in ("table", "ul", "ol", "dl") and name not in ("li", "dt", "dd", "tr", "td", "th"):
                break
            if tag in ends or tag == "p":
                self._end(stack, depth)
                if name in ("td", "th", "li", "p") or tag == "p" and not ends:
                    break

    def text(self, keep: list[bool]) -> str:
        """The texts of kept nodes; white space is one blank, blocks are joined by one blank."""
        parts = [(t if t is not None else " ") for node, t in self.stream if keep[node] or t is None]
        return " ".join("".join(parts).split())
