"""A tolerant HTML reader: block elements as a tree, and the text blocks between their tags."""

from __future__ import annotations

import re
from html import unescape

#: HTML's elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is never text of a page: its content is passed over. Everything else is read and left to the model.
RAW = frozenset("script style textarea title iframe template svg select".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend search".split()
)
#: Elements inside lines that are nodes too, so that the model judges them apart from the text around them.
JUDGED = frozenset("noscript xmp noembed noframes canvas video audio button".split())
#: A start tag of these ends an open element of the second set, unless one of the third stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
LIST_MARKUP = frozenset("li dt dd tr td th tbody thead tfoot caption html head body".split())

#: A comment, a declaration, a whole tag, or the start of one that ``Page._tag_end`` reads on. The bounds here
#: only say which tags are read at once; they change no result. Nothing is tried twice.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/><]*+)(?:((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]{0,1024}+"|'[^']{0,1024}+'|[^\s>"'][^\s>]*+|(?=>))|(?!\s*+=))){0,32}+[\s/]*+)>)?+""", re.S)
#: An attribute, up to the opening quote of its value if that has one. Quotes elsewhere are ordinary characters, as in HTML.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:(["'])|[^\s>]*+))?+)?+""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HINT = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Page:
    """Nodes in page order: tag, parent (-1 for the root), hints (words of class, id and role), own and link characters; blocks: (node, text)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.hints = ["#root"], [-1], [()]
        self.own, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._open: list[tuple[str, int]] = []  # tag, node; -1 for inline elements
        self._count: dict[str, int] = {}
        self._at, self._parts, self._links = 0, [], 0
        self._open_ended: set[int] = set()  # places between attributes from where a quote doesn't close
        self._read(html)

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        last, unclosed = html.rfind(">"), set()
        while at < end:
            m = TAG.search(html, at) if at <= last or html.find("<!--", at) >= 0 else None
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name, attributes = m[2].lower(), m[3]
            if attributes is None:
                close = self._tag_end(html, at)
                if close < 0:
                    self._text(m[0])
                    continue
                at, attributes = close + 1, html[at:close]
            if m[1]:
                self._close(name)
            elif name in RAW:
                # up to the end tag of the same name
                close = None if name in unclosed else re.compile(rf"</{name}\s*+>", re.I).search(html, at)
                if close is None:
                    unclosed.add(name)
                at = close.end() if close else (end if name in ("script", "style", "textarea", "title") else at)
            elif name == "br":
                self._parts.append(" ")
            elif name == "hr":
                self._flush()
            elif name not in VOID:
                self._start(name, attributes)
        self._flush()

    def _tag_end(self, html: str, at: int) -> int:
        """Where the > of a tag is, after its quoted values of any length; where a quote doesn't close, the next >; -1 if there is none."""
        start, seen = at, []
        while at not in self._open_ended:
            seen.append(at)
            m = ATTRIBUTE.match(html, at)
            at = m.end()
            if m[1]:
                at = html.find(m[1], at) + 1
                if not at:
                    break
            elif at == len(html):
                break
            elif html[at] == ">":
                return at
        # each place is gone through once for all tags that end like this
        self._open_ended.update(seen)
        return html.find(">", start)

    def _text(self, text: str) -> None:
        self._parts.append(text)
        if self._count.get("a"):
            self._links += len(text.strip())

    def _flush(self) -> None:
        if self._parts:
            text = "".join(self._parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append((self._at, text))
                self.own[self._at] += len(text)
                self.linked[self._at] += min(self._links, len(text))
            self._parts, self._links = [], 0

    def _start(self, name: str, attributes: str) -> None:
        if name not in BLOCK and name not in JUDGED:
            self._open.append((name, -1))
            self._count[name] = self._count.get(name, 0) + 1
            return
        self._flush()
        if name not in LIST_MARKUP and name not in JUDGED and self._count.get("p"):
            self._pop_to({"p"}, {"table", "td", "th", "caption", "object"})
        if name in ENDS and any(self._count.get(x) for x in ENDS[name][0]):
            self._pop_to(*ENDS[name])
        words = ()
        if "=" in attributes:
            words = tuple(w.lower() for m in NAMES.finditer(attributes) for w in HINT.findall(m[1] or m[2] or m[3] or ""))
        self.tags.append(name)
        self.parents.append(self._at)
        self.hints.append(words)
        self.own.append(0)
        self.linked.append(0)
        self._at = len(self.tags) - 1
        self._open.append((name, self._at))
        self._count[name] = self._count.get(name, 0) + 1

    def _pop(self) -> str:
        name, node = self._open.pop()
        self._count[name] -= 1
        if node >= 0:
            self._at = self.parents[node]
        return name

    def _pop_to(self, names: set[str], between: set[str]) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in names:
                while len(self._open) > i:
                    self._pop()
                return
            if self._open[i][0] in between:
                return

    def _close(self, name: str) -> None:
        if name in BLOCK or name in JUDGED:
            self._flush()
            if self._count.get(name):
                while self._pop() != name:
                    pass
        elif self._count.get(name):
            # an inline end tag closes no block
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i][0] == name:
                    del self._open[i]
                    self._count[name] -= 1
                    return
