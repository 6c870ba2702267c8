"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is cut in leaf blocks: runs of inline content between the starts and ends
of block elements, each with its chain of ancestors. A conditional random field
labels the blocks of a page in order, main text or not; its features are the
ancestors' tags, the words of their class, id and role, and figures of the text
(length, links, punctuation). ``train`` fits it on labelled pages by full-batch
gradient ascent with exact forward-backward sums; pages are decoded by Viterbi.

The labelled pages come from ``labelled_pages``, which writes pages of many
layouts and knows which of their blocks are the article. They are made from a
seed, so every run learns the same model.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, small, strings

# Elements that are part of the line they stand in.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video".split())
# Elements that end an open one of the group when they start.
GROUPS = {t: g for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",), ("p",)) for t in g}
TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([A-Za-z][^\s>/]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s>/]*)([^>]*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@functools.lru_cache(maxsize=1024)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


@functools.lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """What an ancestor adds to the features: its tag and the words of class, id and role."""
    words = [w.lower() for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall(m[1] or m[2] or m[3] or "")]
    return (f"<{tag}>", *[f".{w}" for w in words])


class Chain:
    """An element and, by ``above``, its ancestors; ``fresh`` has the marks that no ancestor has.

    Elements share their ancestors' links, so a page of any depth takes room and
    time in proportion to its elements. ``sums`` keeps a model and its weights' sums.
    """

    __slots__ = ("above", "tag", "fresh", "sums")

    def __init__(self, above: Chain | None, tag: str, fresh: list[str]):
        self.above, self.tag, self.fresh, self.sums = above, tag, fresh, None


Block = tuple[str, Chain | None, int]  # text, its ancestors, characters in links


class _Stack:
    """Open elements."""

    def __init__(self) -> None:
        self.chains: list[Chain] = []
        self.marks: list[tuple[str, ...]] = []
        self.held: dict[str, int] = defaultdict(int)
        self.tags: dict[str, int] = defaultdict(int)

    @property
    def top(self) -> Chain | None:
        return self.chains[-1] if self.chains else None

    def push(self, tag: str, marks: tuple[str, ...]) -> None:
        held, fresh = self.held, []
        for x in marks:
            if not held[x]:
                fresh.append(x)
            held[x] += 1
        self.chains.append(Chain(self.chains[-1] if self.chains else None, tag, fresh))
        self.marks.append(marks)
        self.tags[tag] += 1

    def pop(self) -> str:
        held = self.held
        for x in self.marks.pop():
            held[x] -= 1
        tag = self.chains.pop().tag
        self.tags[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """End the nearest open element of a name, and all that are in it."""
        if self.tags[tag] > 0:
            while self.pop() != tag:
                pass


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order; white space is one space, references are decoded."""
    blocks: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            parts.clear()
            if text:
                blocks.append((text, stack.top, linked))
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            parts.append(page[at:end])
            if in_link:
                linked += end - at

    last = page.rfind(">") + 1  # no tag ends beyond
    while m := TOKEN.search(page, at, last):
        text_to(m.start())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)  # a comment that nothing closes
            continue
        tag = tag.lower()
        closing = bool(m[1] or m[4])
        if tag in INLINE:
            in_link = not closing if tag == "a" else in_link
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if tag in RAW:
            if not closing:
                end = _end_of(tag).search(page, at)
                at = end.end() if end else len(page)
            continue
        if closing:
            in_link = False
            stack.close(tag)
        elif tag not in VOID:
            if stack.top and stack.top.tag == "p":  # a block ends an open paragraph
                stack.pop()
            if (group := GROUPS.get(tag)) and stack.top and stack.top.tag in group:
                stack.pop()
            stack.push(tag, _marks(tag, m[3] or m[6] or ""))
    text_to(len(page))
    flush()
    return blocks


def _text_features(text: str, linked: int) -> list[str]:
    n = len(text.split())
    size = sum(n > k for k in (1, 3, 6, 12, 25, 60))
    links = min(3, int(3 * linked / len(text) + 0.34))
    last = text[-1]
    return [f"n{size}", f"a{links}", f"n{size}a{links}", "end" if last in ".!?…\"”»" else "open", f"c{min(3, text.count(','))}", "©" if "©" in text or "opyright" in text else "-"]


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of each block's features; ancestors count once each, the nearest also as such."""
    out = []
    for text, chain, linked in blocks:
        marks, at = [], chain
        while at:
            marks += at.fresh
            at = at.above
        out.append(["1", *sorted(marks), f"in<{chain.tag}>" if chain else "bare", *_text_features(text, linked)])
    return out


class Crf:
    """Weights of two labels by feature name, and of label pairs."""

    def __init__(self, weight: dict[str, tuple[float, float]], pair: np.ndarray):
        self.weight, self.pair = weight, pair.tolist()

    def _sum(self, names: Iterable[str], start: tuple[float, float]) -> tuple[float, float]:
        a, b = start
        for n in names:
            if w := self.weight.get(n):
                a, b = a + w[0], b + w[1]
        return a, b

    def _chain(self, chain: Chain | None) -> tuple[float, float]:
        """Sums of the weights of a block's ancestors: each element adds to those of the one above it."""
        if chain is None:
            return self._sum(("1", "bare"), (0.0, 0.0))
        todo, at = [], chain
        while at and (at.sums is None or at.sums[0] is not self):
            todo.append(at)
            at = at.above
        got = at.sums[1] if at else self._sum(("1",), (0.0, 0.0))
        for x in reversed(todo):
            got = self._sum(x.fresh, got)
            x.sums = (self, got)
        return self._sum((f"in<{chain.tag}>",), got)

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi: the labels with the highest sum."""
        (p00, p01), (p10, p11) = self.pair
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for k, (text, chain, linked) in enumerate(blocks):
            u0, u1 = self._chain(chain)
            for n in _text_features(text, linked):
                w = self.weight.get(n)
                if w:
                    u0, u1 = u0 + w[0], u1 + w[1]
            if k:
                a, b = s0 + p00, s1 + p10
                c, d = s0 + p01, s1 + p11
                back.append((int(b > a), int(d > c)))
                s0, s1 = max(a, b) + u0, max(c, d) + u1
            else:
                s0, s1 = u0, u1
        y = int(s1 > s0)
        labels = [y] * bool(blocks)
        for step in reversed(back):
            y = step[y]
            labels.append(y)
        return labels[::-1]

    def main_text(self, page: str) -> str:
        blocks = leaf_blocks(page)
        return "\n".join([b[0] for b, y in zip(blocks, self.decode(blocks)) if y])


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 150, rate: float = 0.15, decay: float = 3e-4) -> Crf:
    """Maximum likelihood with a quadratic penalty, by Adam on exact gradients."""
    names, objective = likelihood(pages, decay)
    theta = np.zeros(2 * len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = objective(theta)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-9)
    w = theta[:-4].reshape(-1, 2)
    return Crf({f: (float(w[k, 0]), float(w[k, 1])) for f, k in names.items()}, theta[-4:].reshape(2, 2))


def likelihood(pages: list[tuple[list[Block], list[int]]], decay: float) -> tuple[dict[str, int], Callable[[np.ndarray], tuple[float, np.ndarray]]]:
    """The features' numbers, and the penalised log-likelihood a block as a function of all weights, with its gradient.

    Weights: two for each feature, then the four of label pairs.
    """
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    n, longest = len(pages), max(len(b) for b, _ in pages)
    rows, cols = [], []
    gold = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (blocks, labels) in enumerate(pages):
        gold[i, : len(labels)], mask[i, : len(labels)] = labels, True
        for t, fs in enumerate(features(blocks)):
            for f in fs:
                rows.append(i * longest + t)
                cols.append(names.setdefault(f, len(names)))
    row, col = np.asarray(rows), np.asarray(cols)
    truth = np.stack([(gold == y) & mask for y in (0, 1)], axis=2).astype(float)
    both = mask[:, 1:]
    pair_truth = np.asarray([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    total = mask.sum()

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, pair = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        unary = np.stack([np.bincount(row, weights=w[col, y], minlength=n * longest) for y in (0, 1)], axis=1).reshape(n, longest, 2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = unary[:, 0]
        for t in range(1, longest):
            x = np.logaddexp(alpha[:, t - 1, None, 0] + pair[0], alpha[:, t - 1, None, 1] + pair[1]) + unary[:, t]
            alpha[:, t] = np.where(mask[:, t, None], x, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            z = unary[:, t + 1] + beta[:, t + 1]
            x = np.logaddexp(pair[:, 0] + z[:, None, 0], pair[:, 1] + z[:, None, 1])
            beta[:, t] = np.where(mask[:, t + 1, None], x, 0)
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        marginal = np.exp(np.minimum(0, alpha + beta - log_z[:, None, None])) * mask[:, :, None]
        joint = np.exp(np.minimum(0, alpha[:, :-1, :, None] + pair + (unary + beta)[:, 1:, None, :] - log_z[:, None, None, None])) * both[:, :, None, None]
        gap = (truth - marginal).reshape(-1, 2)
        grad = np.empty_like(theta)
        grad[:-4] = np.stack([np.bincount(col, weights=gap[row, y], minlength=len(names)) for y in (0, 1)], axis=1).ravel()
        grad[-4:] = (pair_truth - joint.sum(axis=(0, 1))).ravel()
        value = (truth * unary).sum() + (pair_truth * pair).sum() - log_z.sum()
        return float(value / total - decay / 2 * (theta @ theta)), grad / total - decay * theta

    return names, objective


# Words in class, id and role names by what they stand for, as the training pages use them.
NAMES = {
    "main": "content article post entry main story text body page",
    "nav": "nav menu navigation breadcrumb breadcrumbs topbar links tabs",
    "header": "header masthead top branding logo banner",
    "footer": "footer bottom copyright legal colophon",
    "side": "sidebar aside side widget related recommended more popular trending archive tags",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion",
    "notice": "notice cookie consent alert gdpr popup overlay modal message",
    "form": "form search login signup subscribe newsletter contact",
    "comment": "comment comments reply replies discussion respond disqus",
    "share": "share social follow meta byline print toolbar",
}


def _words(r: random.Random, low: int, high: int) -> str:
    parts = "ka lo mi ter sen dor an el ist ur ve pa no ri tal gem bo fes qui ha".split()
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))


def _prose(r: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(r.randint(low, high)):
        s = _words(r, 1, 16).capitalize()
        out.append((s.replace(" ", ", ", 1) if r.random() < 0.4 else s) + r.choice(".....!?"))
    return " ".join(out) if r.random() > 0.08 else " ".join(w + r.choice(["***", "&&&", "###", "!!"]) for w in " ".join(out).split())


def labelled_page(r: random.Random) -> tuple[list[Block], list[int]]:
    """A page and, for each of its blocks, whether it belongs to the article.

    Every text starts with a private character that tells its label and is taken off again.
    """
    yes, no = "", ""
    named = r.random() < 0.75  # else a page of plain containers

    def box(kind: str, inner: str, tags: str) -> str:
        tag = r.choice(tags.split()) if named or kind == "main" else "div"
        names = NAMES[kind].split()
        attribute = f' {r.choice(["class", "class", "id"])}="{" ".join(r.sample(names, r.randint(1, 2)))}"' if named and (tag in ("div", "section", "ul", "p") or r.random() < 0.3) else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def link(text: str) -> str:
        return f'<a href="/{r.randint(0, 99)}">{no}{text}</a>'

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f"<li>{link(_words(r, 1, 4))}</li>" for _ in range(r.randint(low, high))) + "</ul>"

    def paragraph() -> str:
        kind = r.random()
        text = yes + _prose(r, 1, r.choice([1, 3, 9, 25]))
        if kind < 0.6:
            return f"<p>{text}</p>"
        if kind < 0.68:
            return f"<p><b>{yes}{_prose(r, 1, 2)}<br><p>{text}</p>"
        if kind < 0.74:
            return "<ul>" + "".join(f"<li>{yes}{_words(r, 2, 14)}{r.choice(['', '.'])}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.8:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.86:
            return f"<h{(k := r.randint(2, 4))}>{yes}{_words(r, 1, 8)}</h{k}>"
        if kind < 0.92:
            return f"<div>{text}</div>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{yes}{_words(r, 1, 3)}</td><td>{yes}{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<pre>{text}</pre>"

    ad = lambda: box("ad", no + _prose(r, 1, 3), "div div aside section")
    side = lambda: box("side", r.choice([links(2, 8), f"<h3>{no}{_words(r, 1, 3)}</h3>{links(1, 5)}", f"<p>{no}{_prose(r, 1, 2)}</p>"]), "aside div section")
    share = lambda: box("share", r.choice([links(2, 4), no + _words(r, 1, 5), f"<p>{no}{_words(r, 2, 6)} 2024</p>"]), "div ul p" if named else "div")
    comment = lambda: box("comment", "".join(f"<div>{no}{_words(r, 1, 2)}</div><p>{no}{_prose(r, 1, 4)}</p>" for _ in range(r.randint(1, 4))), "div section")
    form = lambda: box("form", f"<form><label>{no}{_words(r, 1, 4)}</label><p>{no}{_prose(r, 1, 1)}</p><button>{no}{_words(r, 1, 2)}</button></form>", "div section")
    notice = lambda: box("notice", f"<p>{no}{_prose(r, 1, 3)}</p>", "div section")
    title = _words(r, 2, 9)
    article = [f"<h1>{yes}{title}</h1>"] * (r.random() < 0.85) + [paragraph() for _ in range(r.choice([1, 2, 4, 8, 16]))]
    if named:
        for extra in (ad, side, share, comment, form, notice):
            if r.random() < 0.15:
                article.insert(r.randint(1, len(article)), extra())
    inner = "".join(article)
    body = box("main", inner, "article article main div section") if r.random() < 0.9 or not named else inner
    before = [f"<nav>{links(2, 9)}</nav>" if r.random() < 0.6 else box("nav", links(2, 9), "nav div ul")]
    if r.random() < 0.5:
        before.insert(0, box("header", f"{r.choice(['', f'<h1>{no}{_words(r, 1, 3)}</h1>'])}<p>{no}{_words(r, 1, 6)}</p>", "header header div") if named else f"<header>{no}{_words(r, 1, 6)}</header>")
    if named:
        before += [make() for make in (ad, notice, form, side) if r.random() < 0.3]
    after = [make() for make in (comment, side, form, share, ad, notice) if r.random() < 0.35] if named else []
    foot = no + r.choice([f"&copy; {r.randint(1999, 2026)} {_words(r, 1, 4)}", _prose(r, 1, 2), f"Copyright {_words(r, 1, 3)} &middot; {_prose(r, 1, 1)}"])
    after += [f"<footer>{foot}</footer>" if r.random() < 0.7 or not named else box("footer", f"<p>{foot}</p>{r.choice(['', links(1, 5)])}", "footer div")] * (r.random() < 0.9)
    page = f"<!DOCTYPE html><html><head><title>{no}{title}</title><style>p{{}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
    if r.random() < 0.04:
        page = f"{paragraph()}{paragraph()}"
    blocks, labels = [], []
    for text, chain, linked in leaf_blocks(page):
        labels.append(int(yes in text))
        text = text.replace(yes, "").replace(no, "").strip()
        blocks.append((text or "x", chain, min(linked, len(text))))
    return blocks, labels


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(n)]


@functools.lru_cache(maxsize=1)
def default_model(n: int = 600, seed: int = 20) -> Crf:
    return train(labelled_pages(n, seed))


def main_texts(pages: DataFrame, model: Crf | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (empty if none), ``n_chars`` in code points.

    A null page counts as empty. Repeated rows each give a row, other columns are
    ignored, an empty table gives no row. The whole page is read, however long.
    """
    crf = model or default_model()
    shared = pages.sparkSession.sparkContext.broadcast((crf.weight, np.asarray(crf.pair)))  # one number pair per feature of the training pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("htmltext")
        own = Crf(*shared.value)
        for batch in small(batches):
            texts = [own.main_text(p) for p in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")
