"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A tolerant tokeniser turns a page into leaf blocks, each with its ancestors and text.  The field
has two labels (article or not), binary features of ancestor tags, class words and text shape, and weights
for neighbouring labels.  It is trained by maximum likelihood on labelled pages, which
``labelled_pages`` generates in many layouts, and decoded by Viterbi.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SKIPPED = {"script", "style", "title", "template", "noscript", "svg", "iframe", "textarea", "select", "button", "canvas", "object", "datalist"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = set(
    "html head body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset "
    "legend label blockquote pre address figure figcaption hr details summary dialog center menu option video audio".split()
)
_CLOSES_P = _BLOCK - {"html", "head", "body", "td", "th", "tr", "label", "option", "caption", "legend"}
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"datalist"}),
}
#: Stems of class and id words, by what they tell.
_STEMS = {
    "nav": "nav menu breadcrumb crumbs pagination pager tabs toc skip",
    "head": "header masthead topbar logo branding",
    "foot": "footer bottom copyright colophon legal imprint",
    "side": "sidebar side aside related widget recommend trending popular teaser rail more",
    "ad": "ad ads adv advert advertisement banner sponsor sponsored promo promotion outbrain taboola commercial",
    "comment": "comment comments reply replies discussion disqus respond feedback reader review",
    "notice": "cookie consent notice alert popup modal gdpr overlay newsletter subscribe subscription signup warning announcement toast paywall",
    "share": "share sharing social follow tags meta byline author date toolbar print",
    "form": "form search login signin contact",
    "main": "content article post entry main body story text page articlebody prose document",
}
_STEM_OF = {w: k for k, words in _STEMS.items() for w in words.split()}
_ANCESTORS = set("nav aside header footer main article section form ul ol li table td th blockquote pre figure figcaption dialog details h1 h2 h3 h4 h5 h6 a p address label dl".split())


@lru_cache(50_000)
def _attribute_features(attributes: str) -> tuple[str, ...]:
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        for word in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
            kind = _STEM_OF.get(word) or _STEM_OF.get(word.rstrip("s")) or next((k for s, k in _STEM_OF.items() if len(s) > 5 and word.startswith(s)), None)
            if kind:
                out.append(f"class:{kind}")
    if _HIDDEN.search(attributes):
        out.append("hidden")
    return tuple(out)


class Block:
    __slots__ = ("linked", "marks", "tag", "text")

    def __init__(self, text: str, tag: str, marks: set[str], linked: int):
        self.text, self.tag, self.marks, self.linked = text, tag, marks, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, their references decoded and white space turned into single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[str] = []
    links = linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                marks, tag = set(), "body"
                for name, more in stack:
                    if name in _ANCESTORS:
                        marks.add(f"in:{name}")
                    marks.update(more)
                    if name in _BLOCK:
                        tag = name
                out.append(Block(text, tag, marks, linked))
        linked = 0

    def close(index: int) -> None:
        nonlocal links
        for name, _ in stack[index:]:
            links -= name == "a"
        del stack[index:]

    last = page.rfind(">")
    while at < n:
        if at > last and not page.startswith("<!", at):  # no tag ends behind this place, so a "<" is text; no look for its end from each of them
            end = page.find("<!", at)
            end = n if end < 0 else end
            buffer.append(page[at:end])
            linked += (end - at) * (links > 0)
            at = end
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                buffer.append(m[0])
                if links:
                    linked += len(m[0])
            continue
        name, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            if name in _SKIPPED:
                continue
            if name in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in _SKIPPED:
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n if name in ("script", "style") else at
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in _BLOCK:
                        break
            if name in _IMPLIED:
                ends, within = _IMPLIED[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in within:
                        break
                    if stack[i][0] in ends:
                        close(i)
                        break
        if name in _VOID or attributes.endswith("/"):
            continue
        stack.append((name, _attribute_features(attributes) if attributes else ()))
        links += name == "a"
    flush()
    return out


def features(page_blocks: list[Block]) -> list[list[str]]:
    """Names of each block's features."""
    n = len(page_blocks)
    out = []
    for i, b in enumerate(page_blocks):
        words, size = b.text.count(" ") + 1, len(b.text)
        density = b.linked / max(1, size)
        f = ["bias", f"tag:{b.tag}", *b.marks]
        f.append("words:" + ("1" if words == 1 else "5" if words <= 5 else "12" if words <= 12 else "30" if words <= 30 else "more"))
        f.append("links:" + ("none" if density == 0 else "few" if density < 0.4 else "many" if density < 0.8 else "all"))
        f.append("ends:" + ("stop" if b.text[-1] in ".!?:;…。\"”)" else "comma" if b.text[-1] == "," else "open"))
        if "©" in b.text or "copyright" in b.text.lower():
            f.append("rights")
        if i < 2:
            f.append("first")
        if i >= n - 2:
            f.append("last")
        inside = {m for m in b.marks if m in ("in:article", "in:main", "class:main")}
        if inside:
            f.append("inside")
            f.append(f"inside+{b.tag}")
        else:
            f.append("outside")
        out.append(f)
    return out


class Field:
    """Weights of the field: for each feature and label, and for each pair of neighbouring labels."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.step = np.zeros((2, 2))

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in feats])

    def viterbi(self, feats: list[list[str]]) -> list[int]:
        """The likeliest labels."""
        if not feats:
            return []
        w, ((s00, s01), (s10, s11)) = self._pairs(), self.step.tolist()
        a = b = 0.0
        back = []
        for i, fs in enumerate(feats):
            e0 = e1 = 0.0
            for f in fs:
                x = w.get(f)
                if x:
                    e0 += x[0]
                    e1 += x[1]
            if i:
                p0, p1 = (0, a + s00) if a + s00 >= b + s10 else (1, b + s10), (0, a + s01) if a + s01 >= b + s11 else (1, b + s11)
                back.append((p0[0], p1[0]))
                a, b = p0[1] + e0, p1[1] + e1
            else:
                a, b = e0, e1
        y = int(b > a)
        labels = [y]
        for pointer in reversed(back):
            y = pointer[y]
            labels.append(y)
        return labels[::-1]

    def _pairs(self) -> dict[str, tuple[float, float]]:
        found = self.__dict__.get("_cache")
        if found is None:
            found = self._cache = {k: tuple(v.tolist()) for k, v in self.weights.items()}
        return found

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each block and expected counts of label pairs, by forward-backward."""
        n = len(e)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = e[0]
        for i in range(1, n):
            f[i] = e[i] + np.logaddexp(f[i - 1, 0] + self.step[0], f[i - 1, 1] + self.step[1])
        for i in range(n - 2, -1, -1):
            x = b[i + 1] + e[i + 1]
            b[i] = np.logaddexp(self.step[:, 0] + x[0], self.step[:, 1] + x[1])
        z = np.logaddexp(*f[-1])
        pairs = np.zeros((2, 2))
        if n > 1:
            joint = f[:-1, :, None] + self.step[None] + (b[1:] + e[1:])[:, None, :] - z
            pairs = np.exp(joint).sum(axis=0)
        return np.exp(f + b - z), pairs


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 4, rate: float = 0.3, l2: float = 1e-3, seed: int = 1) -> Field:
    """Maximum likelihood with adaptive gradient steps."""
    model, rng = Field(), np.random.default_rng(seed)
    grown: dict[str, np.ndarray] = {}
    grown_step = np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for k in rng.permutation(len(pages)):
            feats, gold = pages[k]
            if not feats:
                continue
            p, pairs = model.marginals(model.scores(feats))
            p[np.arange(len(gold)), gold] -= 1
            for a, b in zip(gold, gold[1:], strict=False):
                pairs[a, b] -= 1
            gradient: dict[str, np.ndarray] = {}
            for fs, g in zip(feats, p, strict=True):
                for f in fs:
                    gradient[f] = gradient[f] + g if f in gradient else g.copy()
            for f, g in gradient.items():
                w = model.weights.setdefault(f, np.zeros(2))
                g = g + l2 * w
                s = grown.setdefault(f, np.full(2, 1e-6))
                s += g * g
                w -= rate * g / np.sqrt(s)
            grown_step += pairs * pairs
            model.step -= rate * pairs / np.sqrt(grown_step)
    return model


def labelled_pages(n: int, seed: int = 2) -> Iterator[tuple[str, list[int]]]:
    """Generated pages and their blocks' labels (1: article text)."""
    rng = np.random.default_rng(seed)
    syllables = "ka lo mi ten ra su ver ni do pel ist an cho gra be un ter wi fo zen".split()

    def one(items):
        return items[int(rng.integers(len(items)))]

    def phrase(a: int, b: int) -> str:
        return " ".join("".join(one(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(a, b + 1)))).capitalize()

    def sentence_text(short: bool = False) -> str:
        return " ".join(phrase(3, 6 if short else 18) + one("..!?.") for _ in range(int(rng.integers(1, 2 if short else 6))))

    for _ in range(n):
        parts: list[str] = []
        labels: list[int] = []
        style = one(["semantic", "semantic", "class", "class", "mixed", "bare"])

        def put(markup: str, *ys: int, parts=parts, labels=labels) -> None:
            parts.append(markup)
            labels.extend(ys)

        def box(kind: str, tag: str, style=style) -> tuple[str, str]:
            """An opening and a closing tag for a region."""
            word = one(_STEMS[kind].split())
            attr = one([f' class="{word}"', f' id="{word}"', f' class="x{int(rng.integers(9))} {word}-box"'])
            if style == "semantic":
                return f"<{tag}{attr if tag == 'div' or rng.random() < 0.3 else ''}>", f"</{tag}>"
            if style == "bare":
                return (f"<div{attr}>" if rng.random() < 0.3 else "<div>"), "</div>"
            tag = "div" if style == "class" or rng.random() < 0.5 else tag
            return f"<{tag}{attr}>", f"</{tag}>"

        def links(kind: str, tag: str, a: int, b: int, put=put, box=box) -> None:
            start, end = box(kind, tag)
            k = int(rng.integers(a, b))
            items = [f'<a href="/{i}">{phrase(1, 3)}</a>' for i in range(k)]
            if rng.random() < 0.7:
                put(start + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" + end, *[0] * k)
            else:
                put(start + one([" | ", " "]).join(items) + end, 0)

        def region(kind: str, tag: str, put=put, box=box) -> None:
            """A region of text that is not the article's."""
            start, end = box(kind, tag)
            shape = one(["text", "p", "head", "link"])
            if shape == "text":
                put(f"{start}{sentence_text(True)}{end}", 0)
            elif shape == "p":
                k = int(rng.integers(1, 3))
                put(start + "".join(f"<p>{sentence_text(rng.random() < 0.6)}</p>" for _ in range(k)) + end, *[0] * k)
            elif shape == "head":
                put(f"{start}<h3>{phrase(1, 4)}</h3><p>{sentence_text(True)}</p>{end}", 0, 0)
            else:
                put(f'{start}{phrase(2, 6)} <a href="/x">{phrase(1, 4)}</a>{end}', 0)

        def article(put=put) -> None:
            put(f"<{one(['h1', 'h1', 'h2'])}>{phrase(2, 9)}{one(['', '', '.'])}</h1>", 1)
            for _ in range(int(rng.integers(1, 9))):
                shape = one(["p"] * 9 + ["bp", "h", "ul", "quote", "ad", "share", "pre", "aside", "text"])
                if shape == "p" and rng.random() < 0.2:
                    put(f"<p>{phrase(1, 4)}{one(['', '.', '###', '&amp;&amp;'])}</p>", 1)
                elif shape == "p":
                    put(f"<p>{sentence_text()}{one(['</p>', '</p>', ''])}", 1)
                elif shape == "bp":
                    put(f"<p><b>{sentence_text()}<br>", 1)
                elif shape == "text":
                    put(f"<div>{sentence_text()}</div>", 1)
                elif shape == "h":
                    put(f"<h2>{phrase(1, 6)}</h2>", 1)
                elif shape == "ul":
                    k = int(rng.integers(2, 5))
                    put("<ul>" + "".join(f"<li>{sentence_text(True)}</li>" for _ in range(k)) + "</ul>", *[1] * k)
                elif shape == "quote":
                    put(f"<blockquote><p>{sentence_text()}</p></blockquote>", 1)
                elif shape == "pre":
                    put(f"<pre>{phrase(3, 9)}</pre>", 1)
                elif shape == "aside":
                    put(f"<aside>{sentence_text(True)}</aside>", 0)
                elif shape == "ad":
                    put(f'<div class="{one(_STEMS["ad"].split())}">{sentence_text(True)}</div>', 0)
                elif shape == "share":
                    put(f'<div class="{one(_STEMS["share"].split())}">{phrase(1, 5)}</div>', 0)

        def comments(put=put, box=box) -> None:
            start, end = box("comment", "section")
            put(f"{start}<h3>{phrase(1, 3)}</h3>", 0)
            for _ in range(int(rng.integers(1, 5))):
                inner = one(['<div class="comment">', "<li>", '<div class="reply">', '<article class="comment">'])
                put(f"{inner}<p>{sentence_text(rng.random() < 0.5)}</p>{'</li>' if inner == '<li>' else '</article>' if 'article' in inner else '</div>'}", 0)
            parts.append(end)

        parts.append(f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title><style>p{{}}</style></head><body>")
        if rng.random() < 0.4:
            region("notice", one(["div", "dialog"]))
        if rng.random() < 0.5:
            region("head", "header")
        if rng.random() < 0.85:
            links("nav", "nav", 2, 8)
        if rng.random() < 0.4:
            region("ad", "div")
        if rng.random() < 0.2:
            region("side", "aside")
        inner = {"semantic": one([("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>")])}.get(style) or box("main", "article")
        parts.append(inner[0])
        article()
        if rng.random() < 0.15:
            comments()
        parts.append(inner[1])
        if rng.random() < 0.3:
            put(f"<form><label>{phrase(1, 3)}</label><p>{sentence_text(True)}</p></form>", 0, 0)
        if rng.random() < 0.35:
            comments()
        if rng.random() < 0.35:
            links("side", "aside", 2, 6)
        if rng.random() < 0.3:
            region("side", "aside")
        if rng.random() < 0.2:
            region("notice", "div")
        if rng.random() < 0.85:
            start, end = box("foot", "footer")
            if rng.random() < 0.6:
                put(f"{start}&copy; {phrase(1, 3)} &middot; {sentence_text(True)}{end}", 0)
            else:
                parts.append(start)
                links("foot", "div", 1, 4)
                put(f"<p>&copy; {phrase(2, 5)}</p>{end}", 0)
        parts.append("</body></html>")
        yield "".join(parts), labels


@lru_cache(1)
def default_model(pages: int = 500) -> Field:
    rows = []
    for page, labels in labelled_pages(pages):
        found = blocks(page)
        if len(found) != len(labels):
            raise AssertionError("a generated page doesn't parse into its blocks")
        rows.append((features(found), labels))
    return train(rows)


def extract(page: str | None, model: Field) -> str:
    """The page's main text: article blocks in page order, parted by an empty line."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, model.viterbi(features(found)), strict=True) if y)


def with_main_text(pages: DataFrame, model: Field | None = None, column: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole ``html`` in ``column``; a null or empty page gives an empty text.

    Repeated rows give the same text, and ids decide nothing.  A column of that name is replaced, all others stay; no rows give no rows.
    """
    field = model or default_model()

    @F.arrow_udf("string")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), 128):
                out += [extract(x, field) for x in batch.slice(at, 128).to_pylist()]
            yield pa.array(out, type=pa.string())

    return pages.withColumn(column, main_text(F.col("html")))
