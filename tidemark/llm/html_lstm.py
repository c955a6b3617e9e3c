"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: text between block-level tags. Each block becomes a vector of its hashed tag path with class and id
words, its hashed words and a few shape figures. A bidirectional LSTM reads the blocks of a page in order and says for each
whether it is part of the article. It is written in numpy and trained on pages that a seeded generator composes,
with known labels, from many layouts; nothing is taken from the pages to be extracted.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH, ATTRS, WORDS, SHAPE = 48, 48, 32, 12
WIDTH = PATH + ATTRS + WORDS + SHAPE
#: Tags that do not end a block (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is never text of the page: raw ones run to the end of the page if they are not closed, the others only count where they are (fixed values).
RAW, SILENT = "script|style", ("noscript", "template", "iframe", "object", "svg", "math", "canvas", "title")
_INSIDE = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*"


@functools.lru_cache
def _tags(closed: tuple[str, ...]) -> re.Pattern:
    """Comments, silent elements (``closed`` are those whose end tag occurs in the page), declarations and tags."""
    silent = rf"|<({'|'.join(closed)})(?![\w:-]){_INSIDE}(?<!/)>.*?</\2\s*>" if closed else "|(?!)()"
    return re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?![\w:-]){_INSIDE}>.*?(?:</\1\s*>|\Z){silent}|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_INSIDE})(?:>|\Z)", re.S | re.I)


_NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+", re.I)
_SPACES = re.compile(r"\s+")
#: Open elements that a new block element closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


@functools.lru_cache(1 << 16)
def bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    attrs: tuple[str, ...]
    linked: int = 0
    raw: int = 0
    parts: list[str] = field(default_factory=list)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; character references decoded, white space joined."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0
    page = page or ""

    def flush():
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), tuple(w for _, a in stack for w in a), linked, len(text)))
        linked = 0

    def say(piece: str):
        nonlocal linked
        if piece:
            piece = entities.unescape(piece)
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())

    lower = page.lower()
    for m in _tags(tuple(t for t in SILENT if f"</{t}" in lower)).finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m[3] else 1
        if name in INLINE or name in SILENT:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        if m[3]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    in_link = 0
                    break
        else:
            ends = _CLOSES.get(name)
            while stack and ((ends and stack[-1][0] in ends) or stack[-1][0] == "p"):
                stack.pop()
            if name not in VOID and not m[5].rstrip().endswith("/"):
                names = tuple(w.lower() for x in _NAMED.findall(m[5]) for w in _WORD.findall("".join(x))) if m[5] else ()
                stack.append((name, names))
    say(page[at:])
    flush()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """A row of features per block: its whole tag path, all class words and all its words (those of a long block weigh less each)."""
    out = np.zeros((len(page), WIDTH), np.float32)
    for i, b in enumerate(page):
        v = out[i]
        for d, tag in enumerate(reversed(b.path)):
            v[bucket(tag, PATH)] += 1.0 if d < 2 else 0.6
        for w in b.attrs:
            v[PATH + bucket(w, ATTRS)] += 1.0
        words = _WORD.findall(b.text.lower())
        if words:
            hashed = np.bincount([bucket(w, WORDS) for w in words], minlength=WORDS)
            v[PATH + ATTRS : PATH + ATTRS + WORDS] = hashed * min(0.3, 3.6 / len(words))
        n, s = len(b.text), v[PATH + ATTRS + WORDS :]
        k = b.text.count(" ") + 1
        s[:] = (
            1.0, math.log1p(n) / 8, min(1.0, b.linked / n), min(1.0, (b.text.count(".") + b.text.count(",")) / k * 4), float(b.text[-1] in ".!?…»\""),
            k < 6, 6 <= k < 25, k >= 25, i == 0, (i + 1) / len(page), float("©" in b.text), 1.0 / (1 + len(b.path)),
        )
    return np.clip(out, -3, 3)


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block; plain numpy, seeded."""

    def __init__(self, hidden: int = 20, seed: int = 3):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["W" + d] = r.normal(0, 0.12, (WIDTH + hidden, 4 * hidden)).astype(np.float32)
            self.p["b" + d] = np.zeros(4 * hidden, np.float32)
            self.p["b" + d][hidden : 2 * hidden] = 1.0
        self.p["V"] = r.normal(0, 0.2, (2 * hidden, 1)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x, mask, d, keep):
        """x: (T, N, WIDTH), mask: (T, N, 1). Padding leaves the state as it is."""
        T, N, _ = x.shape
        H, W, b = self.h, self.p["W" + d], self.p["b" + d]
        h, c = np.zeros((N, H), np.float32), np.zeros((N, H), np.float32)
        out, saved = np.zeros((T, N, H), np.float32), [None] * T
        pre = x.reshape(T * N, -1) @ W[:WIDTH] + b
        pre = pre.reshape(T, N, 4 * H)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            z = pre[t] + h @ W[WIDTH:]
            i, f, o, g = _sig(z[:, :H]), _sig(z[:, H : 2 * H]), _sig(z[:, 2 * H : 3 * H]), np.tanh(z[:, 3 * H :])
            m = mask[t]
            c2 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c2)
            h2 = m * (o * tc) + (1 - m) * h
            if keep:
                saved[t] = (h, c, i, f, o, g, tc)
            h, c = h2, c2
            out[t] = h
        return out, saved

    def forward(self, x, mask, keep=False):
        f, sf = self._run(x, mask, "f", keep)
        b, sb = self._run(x, mask, "b", keep)
        z = np.concatenate([f, b], 2) @ self.p["V"] + self.p["c"]
        return _sig(z[..., 0]), (f, b, sf, sb)

    def _back(self, x, mask, d, dout, saved, grad):
        T, N, _ = x.shape
        H, W = self.h, self.p["W" + d]
        dh, dc = np.zeros((N, H), np.float32), np.zeros((N, H), np.float32)
        for t in range(T - 1, -1, -1) if d == "f" else range(T):
            h, c, i, f, o, g, tc = saved[t]
            m = mask[t]
            dh = dh + dout[t]
            dcell = dc + m * dh * o * (1 - tc * tc)
            dz = m * np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dh * tc * o * (1 - o), dcell * i * (1 - g * g)], 1)
            grad["W" + d][:WIDTH] += x[t].T @ dz
            grad["W" + d][WIDTH:] += h.T @ dz
            grad["b" + d] += dz.sum(0)
            dc = m * dcell * f + (1 - m) * dc
            dh = dz @ W[WIDTH:].T + (1 - m) * dh

    def step(self, x, y, mask):
        """Gradients of the mean cross-entropy over the real blocks."""
        p, (f, b, sf, sb) = self.forward(x, mask, True)
        n = mask.sum()
        dz = ((p - y) * mask[..., 0] / n)[..., None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        both = np.concatenate([f, b], 2)
        grad["V"] = np.einsum("tnh,tno->ho", both, dz)
        grad["c"] = dz.sum((0, 1))
        dout = dz @ self.p["V"].T
        self._back(x, mask, "f", dout[..., : self.h], sf, grad)
        self._back(x, mask, "b", dout[..., self.h :], sb, grad)
        loss = -(mask[..., 0] * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
        return float(loss), grad

    def label(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Probabilities per block; pages of similar length run together, at most ``cells`` padded blocks at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order, k = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i])), 0
        while k < len(order):
            end = k + 1
            while end < len(order) and (end - k + 1) * len(pages[order[end]]) <= cells:
                end += 1
            x, mask = pad([pages[i] for i in order[k:end]])
            p, _ = self.forward(x, mask)
            for j, i in enumerate(order[k:end]):
                out[i] = p[: len(pages[i]), j]
            k = end
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    T = max(len(v) for v in pages)
    x, mask = np.zeros((T, len(pages), WIDTH), np.float32), np.zeros((T, len(pages), 1), np.float32)
    for j, v in enumerate(pages):
        x[: len(v), j], mask[: len(v), j] = v, 1
    return x, mask


#: Container tags and class names of the layouts that the generator composes (fixed values).
GOOD = (("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post entry"), ("section", "story"), ("div", "main text"), ("div", ""))
BAD = (
    ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", "nav menu"), ("ul", "menu"), ("div", "header top"), ("div", "footer bottom"), ("div", "sidebar"), ("div", "ad"),
    ("div", "ads banner"), ("div", "advert sponsored"), ("div", "promo"), ("div", "cookie notice"), ("div", "consent banner"), ("div", "newsletter signup"), ("div", "share social"), ("div", "related links"),
    ("div", "breadcrumb"), ("section", "comments"), ("div", "comment reply"), ("ol", "comment list"), ("div", "login form"), ("div", "widget"), ("div", "copyright"), ("div", "pagination"), ("div", "popup modal"), ("dialog", ""), ("div", "alert notice"),
)
SYLLABLES = "an ble ci de en er es fo ge ha in ka le ment mo na on or pa que ra re st ta the ti to un ver wh za".split()


def compose_page(r: np.random.Generator) -> tuple[str, list[bool]]:
    """A random page and, for each of its leaf blocks, whether it is part of the article."""
    word = lambda: "".join(r.choice(SYLLABLES, r.integers(1, 4)))

    def words(lo, hi):
        w = [word() for _ in range(int(r.integers(lo, hi)))]
        style = r.integers(0, 12)
        if style == 0:
            w = [x.upper() + "!!" for x in w]
        elif style == 1:
            w = [x + str(r.choice(["&amp;&amp;", "%%%", "***", "$$$", "###"])) for x in w]
        elif style == 2:
            w = [x for x in " | ".join(w).split(" ")]
        elif style == 3:
            w = [w[0]] * len(w)
        end = "." if r.random() < 0.75 else ""
        return " ".join(w).capitalize() + end if style > 2 else " ".join(w)

    def tag(name, cls, inner):
        kind = "id" if r.random() < 0.25 else "class"
        if cls and r.random() < 0.3:
            cls = cls.replace(" ", "-")
        return f'<{name}{f" {kind}=\"{cls}\"" if cls else ""}>{inner}</{name}>'

    labels: list[bool] = []

    def bad():
        name, cls = BAD[r.integers(len(BAD))]
        kind = r.integers(0, 5)
        if kind <= 1:
            n = int(r.integers(1, 8))
            items = "".join(f"<li><a href='/{word()}'>{words(1, 4)}</a></li>" for _ in range(n))
            labels.extend([False] * n)
            return tag(name, cls, items if name in ("ul", "ol") else f"<ul>{items}</ul>")
        if kind == 2:
            n = int(r.integers(1, 4))
            labels.extend([False] * n)
            return tag(name, cls, "".join(f"<p>{words(2, 40)}</p>" for _ in range(n)))
        labels.append(False)
        lead = "&copy; " if name == "footer" or r.random() < 0.1 else ""
        return tag(name, cls, lead + words(2, 30))

    def good():
        name, cls = GOOD[r.integers(len(GOOD))]
        inner = []
        if r.random() < 0.7:
            labels.append(True)
            inner.append(f"<h1>{words(1, 10)}</h1>")
        for _ in range(int(r.integers(1, 12))):
            kind = r.integers(0, 12)
            if kind == 0:
                labels.append(True)
                inner.append(f"<h2>{words(1, 7)}</h2>")
            elif kind == 1:
                n = int(r.integers(1, 5))
                labels.extend([True] * n)
                inner.append("<ul>" + "".join(f"<li>{words(1, 25)}</li>" for _ in range(n)) + "</ul>")
            elif kind == 2:
                labels.append(True)
                inner.append(f"<blockquote>{words(4, 30)}</blockquote>")
            elif kind == 3 and r.random() < 0.5:
                inner.append(bad())
            elif kind == 4:
                labels.append(True)
                inner.append(f"<p><b>{words(1, 40)}<br>")
            else:
                labels.append(True)
                inner.append(f"<p>{words(1, 8) if r.random() < 0.3 else words(8, 90)}</p>")
        return tag(name, cls, "".join(inner))

    body = [bad() for _ in range(int(r.integers(0, 4)))] + [good()] + [bad() for _ in range(int(r.integers(0, 5)))]
    inner = "".join(body)
    if r.random() < 0.4:
        inner = tag("div", str(r.choice(["wrapper", "page", "container", "site"])), inner)
    return f"<html><head><title>{words(1, 6)}</title></head><body>{inner}</body></html>", labels


@functools.lru_cache(maxsize=2)
def trained(pages: int = 1000, steps: int = 200, batch: int = 40, seed: int = 11, rate: float = 0.01) -> Labeller:
    """The labeller after training on ``pages`` generated pages; the same weights on every run."""
    r = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        page, labels = compose_page(r)
        found = blocks(page)
        if len(found) == len(labels) and found:
            data.append((vectors(found), np.array(labels, np.float32)))
    net = Labeller()
    m, v = {k: np.zeros_like(p) for k, p in net.p.items()}, {k: np.zeros_like(p) for k, p in net.p.items()}
    for step in range(1, steps + 1):
        pick = [data[i] for i in r.integers(0, len(data), batch)]
        x, mask = pad([a for a, _ in pick])
        y = np.zeros(mask.shape[:2], np.float32)
        for j, (_, label) in enumerate(pick):
            y[: len(label), j] = label
        _, grad = net.step(x, y, mask)
        norm = math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


def _extracted(shared, threshold: float):
    def run(frames):
        net = shared.value
        for pdf in frames:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                found = [blocks(p) for p in part["html"]]
                scores = net.label([vectors(b) for b in found])
                text = ["\n".join(b.text for b, p in zip(page, s, strict=True) if p >= threshold) for page, s in zip(found, scores, strict=True)]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": [len(t) for t in text]})

    return run


def extract(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null and empty pages, and pages without article blocks, give an empty text. Null ids and addresses are passed on, repeated
    rows are extracted again. An empty table gives no rows. Other columns are ignored.
    """
    pages = pages.select("page_id", "url", F.col("html"))
    shared = pages.sparkSession.sparkContext.broadcast(trained())
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInPandas(_extracted(shared, threshold), f"page_id {kind}, url string, text string, n_chars long")
