"""The tree model of page content, and the labelled pages that train it.

Every block element is a binary variable, content or not. Its log-odds are a
weighted sum of features: its tag and the sectioning element around it, apart and
together, whether it holds a main heading, how much text is its own, the share of links, sentence ends, and the words of its class,
id and role. A 2 x 2 table of potentials ties it to its parent. On the tree,
sum-product messages (children to parents, then parents to children) give exact
marginals; training climbs the likelihood of labelled pages by its gradient,
observed less expected features and pairs.

Labelled pages are written by ``labelled_pages``: elements of many layouts, each
marked as content or not, with names that pages give such elements, with neutral
names, and without any, so that words only count for what they are worth there.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import cache
from math import exp, log, log1p

from barleaf.llm.dom import Page

#: Words that pages name elements by, by what the elements are; they are written into labelled pages.
NAMES = {
    "content": "article body content entry main post story text hentry prose copy".split(),
    "ad": "ad ads advert adverts advertisement banner promo promoted promotion sponsor sponsored dfp adsense".split(),
    "notice": "consent cookie cookies notice popup modal alert gdpr overlay paywall".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc toolbar pagination pager skip links".split(),
    "header": "header masthead top login logo".split(),
    "footer": "footer copyright bottom legal".split(),
    "aside": "sidebar related aside widget rail trending popular recommended".split(),
    "share": "share sharing social follow".split(),
    "form": "newsletter signup subscribe search contact".split(),
    "comments": "comment comments disqus replies reply respond responses discussion thread".split(),
    "neutral": "wrapper page container row col box inner outer left right block site group item unit grid layout holder module wide".split(),
}
LEAST_PAGES = 3
SEMANTIC = frozenset("article main nav header footer aside form section body menu".split())


def softplus(x: float) -> float:
    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


def node_features(page: Page, known: frozenset[str] | None = None) -> list[list]:
    """Names of the features that each node has. known: the words that count as themselves; all others are one."""
    tags, parents, n = page.tags, page.parents, len(page.tags)
    text, links = list(page.own), list(page.linked)
    for i in range(n - 1, 0, -1):
        text[parents[i]] += text[i]
        links[parents[i]] += links[i]
    sentence = [False] * n
    for node, block in page.blocks:
        if block[-1] in ".!?…" and len(block) > 30:
            sentence[node] = True
    titled = [False] * n
    for i in range(1, n):
        titled[parents[i]] |= tags[i] == "h1"
    inside: list = [None] * n
    out = []
    for i in range(n):
        p = parents[i]
        inside[i] = (tags[p] if tags[p] in SEMANTIC else inside[p]) if p >= 0 else None
        words = page.hints[i]
        f = [("tag", tags[i]), ("in", inside[i]), ("tag in", tags[i], inside[i]), ("own", min(5, page.own[i].bit_length() // 2)), ("links", 4 * links[i] // text[i] if text[i] else -1)]
        if sentence[i]:
            f.append("sentence")
        if titled[i]:
            f.append("titled")
        out.append(f + [("word", w) for w in sorted({w if known is None or w in known else "?" for w in words})])
    return out


class TreeModel:
    def __init__(self):
        self.weights: dict = {}
        self.words: frozenset[str] = frozenset()
        #: log potentials of (parent, child): both out, child in, parent in, both in
        self.pairs = [0.0, 0.0, 0.0, 0.0]

    def odds(self, features: list[list]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in fs) for fs in features]

    def messages(self, parents: list[int], own: list[float]) -> tuple[list[float], list[float], list[float]]:
        """Log-odds by node: of its subtree alone, what it sends up, and its belief."""
        oo, oi, io, ii = self.pairs
        n = len(parents)
        below, up = list(own), [0.0] * n
        for i in range(n - 1, 0, -1):
            b = below[i]
            up[i] = io + softplus(ii - io + b) - oo - softplus(oi - oo + b)
            below[parents[i]] += up[i]
        belief = list(below)
        for i in range(1, n):
            rest = belief[parents[i]] - up[i]
            belief[i] = below[i] + oi + softplus(ii - oi + rest) - oo - softplus(io - oo + rest)
        return below, up, belief

    def content(self, page: Page) -> list[float]:
        """The log-odds of content for each node."""
        return self.messages(page.parents, self.odds(node_features(page, self.words)))[2]

    def train(self, pages: list[tuple[Page, list[int]]], rounds: int = 40, rate: float = 0.3, ridge: float = 0.002) -> None:
        """Adaptive gradient steps, page by page. Words in fewer than LEAST_PAGES pages are unknown ones."""
        seen = Counter(w for p, _ in pages for w in {w for words in p.hints for w in words})
        self.words = frozenset(w for w, n in seen.items() if n >= LEAST_PAGES)
        data = [(p, node_features(p, self.words), y) for p, y in pages]
        size: dict = {}
        for _ in range(rounds):
            for page, features, y in data:
                below, up, belief = self.messages(page.parents, self.odds(features))
                grad: dict = {}
                for i, fs in enumerate(features):
                    d = y[i] - (1 / (1 + exp(-max(-30.0, min(30.0, belief[i])))))
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + d
                oo, oi, io, ii = self.pairs
                for i in range(1, len(y)):
                    rest = belief[page.parents[i]] - up[i]
                    z = [oo, oi + below[i], io + rest, ii + rest + below[i]]
                    top = max(z)
                    e = [exp(x - top) for x in z]
                    for k in range(4):
                        grad["pair", k] = grad.get(("pair", k), 0.0) + (2 * y[page.parents[i]] + y[i] == k) - e[k] / sum(e)
                for f, g in grad.items():
                    pair = isinstance(f, tuple) and f[0] == "pair"
                    w = self.pairs[f[1]] if pair else self.weights.get(f, 0.0)
                    g -= ridge * w
                    size[f] = size.get(f, 1.0) + g * g
                    w += rate * g / size[f] ** 0.5
                    if pair:
                        self.pairs[f[1]] = w
                    else:
                        self.weights[f] = w


MARK = re.compile(r'<(\w+) y([01])')


def labelled_pages(count: int = 480, seed: int = 5, names: dict[str, list[str]] | None = None) -> list[tuple[Page, list[int]]]:
    """Pages of several layouts with the label of each node. names: other words than NAMES."""
    rng, names = random.Random(seed), names or NAMES
    letters = "etaoinshrdlu"

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b)))

    def some(p: float, make) -> str:
        return make() if rng.random() < p else ""

    def sentence(a=4, b=30) -> str:
        return words(a, b).capitalize() + rng.choice("..?!")

    def named(kind: str, p: float = 0.75) -> str:
        """A class or id that says what the element is, in known words or not, or only a neutral one, or none."""
        if rng.random() >= p:
            return some(0.4, lambda: f' class="{rng.choice(names["neutral"])}"')
        parts = [rng.choice(names[kind]) if rng.random() < 0.9 else words(1, 1), *rng.sample(names["neutral"], rng.choice([0, 0, 1, 2]))]
        rng.shuffle(parts)
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice("-_ ").join(parts)}{rng.choice(["", "", "-1", "2"])}"'

    def element(tag: str, label: int, name: str, inner: str) -> str:
        return f"<{tag} y{label}{name}>{inner}</{tag}>"

    def menu(tag: str, name: str) -> str:
        items = "".join(f'<li y0><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(2, 9)))
        return element(tag, 0, name, f"<ul y0>{items}</ul>")

    def off(tag: str, name: str, inner: str | None = None) -> str:
        return element(tag, 0, name, inner if inner is not None else sentence(3, 14))

    def plain_off() -> str:
        """Text of what is not the article: bare, or in paragraphs."""
        return rng.choice([lambda: sentence(3, 20), lambda: f"<p y0>{sentence()}</p>", lambda: f"<p y0>{sentence()}</p><p y0>{sentence(3, 12)}</p>", lambda: f"<h3 y0>{words(1, 4)}</h3><p y0>{sentence()}</p>"])()

    def para() -> str:
        return f"<p y1>{' '.join(sentence(2, 30) for _ in range(rng.choice([1, 1, 2, 4, 6, 12])))}</p>" if rng.random() < 0.8 else f"<p y1>{rng.choice([words(1, 4) + '.', sentence(1, 8), words(1, 12)])}</p>"

    def body_part() -> str:
        return rng.choices([
            para, lambda: element(rng.choice(["h2", "h3", "h4"]), 1, "", words(1, 6)), lambda: element(rng.choice(["ul", "ol"]), 1, "", "".join(f"<li y1>{words(2, 14)}</li>" for _ in range(rng.randint(2, 5)))),
            lambda: element("blockquote", 1, "", para()), lambda: element("figure", 1, "", element("figcaption", 1, "", words(3, 9))),
            lambda: element("table", 1, "", "".join(f"<tr y1><td y1>{words(1, 5)}</td><td y1>{words(1, 5)}</td></tr>" for _ in range(rng.randint(1, 3)))),
            lambda: element("div", 1, named("content", 0.2), para() + para()), lambda: element("section", 1, "", element("h2", 1, "", words(1, 6)) + para() + para()), lambda: element("pre", 1, "", words(3, 20)),
            lambda: element("dl", 1, "", f"<dt y1>{words(1, 4)}</dt><dd y1>{sentence()}</dd>"), lambda: element("div", 1, "", sentence()),
        ], [70, 6, 8, 4, 3, 3, 3, 3, 2, 1, 2])[0]()

    def inserted() -> str:
        """What stands between the parts of an article without being one."""
        form = lambda: f"<form y0{named('form', 0.4)}><p y0>{words(1, 5)}</p><div y0>{words(1, 3)}</div></form>"
        return rng.choice([
            lambda: off("div", named("ad", 0.95), rng.choice([None, plain_off()])), lambda: off("aside", named("aside", 0.4), plain_off()), lambda: menu("div", named("aside", 0.7)), lambda: menu(rng.choice(["div", "ul", "section"]), named("share", 0.7)),
            lambda: menu("nav", named("menu", 0.4)), lambda: off("div", named("form", 0.95), f"<p y0>{sentence()}</p>" + form()), form, lambda: off("div", named("notice", 0.95), plain_off()),
            lambda: off("header", "", f"<p y0>{words(2, 6)}</p>"), lambda: off("footer", "", f"<p y0>{words(2, 8)}</p>"), lambda: off("p", named("ad", 0.95)),
        ])()

    def comments() -> str:
        tag = rng.choice(["div", "li", "article"])
        each = "".join(element(tag, 0, named("comments", 0.9), rng.choice([f"<p y0>{sentence()} {sentence()}</p>", f"<h4 y0>{words(1, 2)}</h4><p y0>{sentence()}</p>", f"<div y0>{words(1, 3)}</div><div y0>{sentence()}</div>"])) for _ in range(rng.randint(1, 5)))
        return element(rng.choice(["section", "div", "aside"]), 0, named("comments", 0.97), f"<h2 y0>{words(1, 3)}</h2>{each}{some(0.3, lambda: f'<form y0><p y0>{words(1, 4)}</p></form>')}")

    def heading() -> str:
        title = element("h1", 1, "", rng.choice([words(1, 10), words(1, 10), sentence(1, 12)]))
        if rng.random() < 0.15:  # no heading, or a lesser one
            return some(0.5, lambda: element("h2", 1, "", words(1, 10)))
        return title if rng.random() < 0.8 else f"<div y1>{title}<p y1>{words(3, 8)}</p></div>"

    pages = []
    for _ in range(count):
        tag, name = rng.choice([("article", ""), ("article", ""), ("article", named("content")), ("main", ""), ("div", named("content", 1)), ("div", named("content", 1)), ("section", named("content", 1))])
        parts = [heading(), *(body_part() for _ in range(rng.choice([0, 1, 1, 2, 4, 8, 14])))]
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3])):
            parts.insert(rng.randint(1, len(parts)), inserted())
        main = element(tag, 1, name, "".join(parts) + some(0.15, comments))
        side = lambda: off(rng.choice(["aside", "div"]), named("aside", 0.97), f"<h3 y0>{words(1, 4)}</h3>" + menu("div", "") + f"<p y0>{sentence()}</p>")
        around = main
        if rng.random() < 0.35:
            around = element("div", 0, f' class="{rng.choice(names["neutral"])}"', main + some(0.5, side))
        elif rng.random() < 0.2:
            around = element("main", 0, "", main + some(0.5, side))
        top = rng.choice([lambda: menu("nav", named("menu", 0.3)), lambda: off("header", named("header", 0.3), f"<div y0>{words(1, 3)}</div>" + menu("nav", "")), lambda: menu("div", named("menu", 0.97)), lambda: off("div", named("header", 0.97), f"<h1 y0>{words(1, 3)}</h1>" + menu("div", named("menu")))])
        foot = rng.choice([lambda: off("footer", named("footer", 0.3)), lambda: off("div", named("footer", 0.97), plain_off()), lambda: off("footer", "", f"<p y0>{sentence()}</p>" + menu("div", ""))])
        html = "".join([
            "<html y0><body y0>", some(0.25, lambda: off("div", named("notice", 0.97), plain_off())), top(), some(0.5, lambda: off(rng.choice(["div", "section"]), named("ad", 0.97), rng.choice([None, plain_off()]))), around,
            some(0.3, side), some(0.3, comments), some(0.2, lambda: off("form", named("form", 0.5), f"<p y0>{words(2, 9)}</p>")), foot(), "</body></html>",
        ])
        if rng.random() < 0.25:  # pages without their outer elements
            html = html.replace("<html y0><body y0>", "").replace("</body></html>", "")
        labels = [0, *(int(m[2]) for m in MARK.finditer(html))]
        page = Page(MARK.sub(r"<\1", html))
        if len(page.tags) == len(labels):
            pages.append((page, labels))
    return pages


@cache
def trained() -> TreeModel:
    model = TreeModel()
    model.train(labelled_pages())
    return model
