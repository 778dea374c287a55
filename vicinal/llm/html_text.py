"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks (runs of text between block-level tags), each with the path of tags that are
open around it. A block becomes a vector of hashed path parts (tag names, classes, ids), hashed words
and a few measures (length, share of link text, depth, place). A bidirectional LSTM in numpy reads the
vectors of all blocks of a page in order and says of each, with the whole page as context, whether it
belongs to the article; blocks under the same tag path then draw each other's scores together. Scripts, styles and markup are never blocks; self-closed ``svg`` and ``math`` are
empty, and custom elements (``video-js``) are tags like others.

The labeller is trained on pages that ``sample_page`` makes up, with known labels; the training is
seeded and takes a few seconds.

Null and empty pages, and pages without article blocks, have the empty text. Broken markup (tags that
are never closed, or closed twice) is read like browsers do in simple cases. Very long pages are one
long sequence, whose words and blocks are all read; pages run through the LSTM together as long as their
padded blocks number under ``CELLS``, so memory follows the longest page alone. Depth costs nothing: open tags
are kept as counts. Repeated pages are extracted one by one; empty tables give no rows; a probability of just
the threshold counts as article. Columns called ``text`` or ``n_chars`` give way to the new ones.
"""

from __future__ import annotations

import functools
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns

PATH_DIM = 96
WORD_DIM = 48
MEASURES = 8
DIM = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 20
#: Blocks, padding included, of pages that run together.
CELLS = 1 << 14

# Roles of HTML tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"label", "button", "option"}
SILENT = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video"

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>|<({SILENT})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@functools.lru_cache(1 << 14)
def _parts(tag: str, attributes: str) -> tuple[str, ...]:
    """Path parts of a tag: its name, and the words of its class, id and role."""
    out = [tag]
    for m in ATTRIBUTE.finditer(attributes):
        out += [f".{w}" for w in re.split(r"[\s_-]+", (m[2] or m[3] or m[4] or "").lower()) if w]
    return tuple(out)


@functools.lru_cache(1 << 16)
def _bucket(part: str, dim: int) -> int:
    return zlib.crc32(part.encode()) % dim


class Block:
    """A block's text, the hashed parts of the tags around it, its share of link text and its depth."""

    __slots__ = ("text", "path", "link", "depth")

    def __init__(self, text: str, path: bytes, link: float, depth: int):
        self.text, self.path, self.link, self.depth = text, path, link, depth


#: Items that end where the next one of their kind begins.
ITEMS = frozenset("li dt dd option tr td th".split())


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page, in order: references decoded, white space made single."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple]] = []
    open_tags: dict[str, int] = {}
    around, path = [0] * PATH_DIM, bytearray(PATH_DIM)  # open parts in each bucket, and whether there are any
    text: list[str] = []
    links = 0

    def close(at: int):
        for tag, buckets in stack[at:]:
            open_tags[tag] -= 1
            for b in buckets:
                around[b] -= 1
                path[b] = around[b] > 0
        del stack[at:]

    def flush():
        nonlocal links
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, bytes(path), min(1.0, links / len(whole)), len(stack)))
            text.clear()
        links = 0

    def add(piece: str):
        nonlocal links
        if piece:
            text.append(piece)
            if open_tags.get("a"):
                links += len(piece.strip())

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if m[2]:  # an end tag closes up to the last tag of its name, if there is one
            if open_tags.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
            continue
        if tag in VOID:
            continue
        if (tag in CLOSES_P or tag in ITEMS) and (open_tags.get("p") or tag in ITEMS and open_tags.get(tag)):
            # an open paragraph (or item of the same kind) ends here
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (stack[i][0] == tag and tag in ITEMS):
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if not m[4].rstrip().endswith("/") or tag in BLOCK:
            buckets = tuple(_bucket(part, PATH_DIM) for part in _parts(tag, m[4]))
            stack.append((tag, buckets))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            for b in buckets:
                around[b] += 1
                path[b] = 1
    add(page[at:])
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """One row per block."""
    x = np.zeros((len(page), DIM), np.float32)
    n = len(page)
    x[:, :PATH_DIM] = np.frombuffer(b"".join(b.path for b in page), np.uint8).reshape(n, PATH_DIM)
    for i, b in enumerate(page):
        words = b.text.lower().split()
        counts = np.bincount([zlib.crc32(w.encode()) % WORD_DIM for w in words], minlength=WORD_DIM)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.minimum(counts, 3) / np.sqrt(len(words))
        chars = len(b.text)
        marks = b.text.count(".") + b.text.count(",")
        x[i, -MEASURES:] = (np.log1p(chars) / 5, np.log1p(len(words)) / 4, b.link, min(b.depth, 40) / 10, i / max(1, n - 1), b.text[-1] in ".!?…", min(1.0, 10 * marks / max(10, chars)), 1.0)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for each step."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.08, (DIM + HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p[f"c{d}"] = bias
        self.p["out"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None):
        """Hidden states (time, page, HIDDEN) of one direction; ``keep`` gathers what the backward pass needs."""
        steps, pages = mask.shape
        w, h, c = self.p[f"w{d}"], np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        pre = x @ w[:DIM] + self.p[f"c{d}"]
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ w[DIM:]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g))
            c = np.where(m, f * c + i * g, c)
            h = np.where(m, o * np.tanh(c), h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(d, x, mask, None) for d in "fb"], axis=2)
        return _sigmoid(both @ self.p["out"] + self.p["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        kept = {d: [] for d in "fb"}
        hidden = {d: self._run(d, x, mask, kept[d]) for d in "fb"}
        both = np.concatenate([hidden["f"], hidden["b"]], axis=2)
        err = (_sigmoid(both @ self.p["out"] + self.p["bias"]) - y) * mask / max(1, mask.sum())
        grad = {"out": np.tensordot(err, both, ((0, 1), (0, 1))), "bias": np.array([err.sum()], np.float32)}
        for k, d in enumerate("fb"):
            w = self.p[f"w{d}"]
            gw, gc = np.zeros_like(w), np.zeros_like(self.p[f"c{d}"])
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g in reversed(kept[d]):
                m = mask[t][:, None]
                dh = dh + err[t][:, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
                c1 = np.tanh(f * c0 + i * g)
                dct = np.where(m, dc + dh * o * (1 - c1 * c1), 0)
                dz = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), np.where(m, dh * c1, 0) * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                gw[:DIM] += x[t].T @ dz
                gw[DIM:] += h0.T @ dz
                gc += dz.sum(axis=0)
                dh = np.where(m, 0, dh) + dz @ w[DIM:].T
                dc = np.where(m, dct * f, dc)
            grad[f"w{d}"], grad[f"c{d}"] = gw, gc
        return grad

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability, for every block of every page, of belonging to the article."""
        out: list = [np.empty(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            stop = at + 1  # pages come by length, so the last one sets the padding
            while stop < len(order) and (stop + 1 - at) * len(pages[order[stop]]) <= CELLS:
                stop += 1
            some = order[at:stop]
            x, mask = _padded([features(pages[i]) for i in some])
            s = self.scores(x, mask)
            for k, i in enumerate(some):
                out[i] = _with_path_mates(s[: len(pages[i]), k], pages[i])
            at = stop
        return out


def _with_path_mates(score: np.ndarray, page: list[Block], own: float = 0.6) -> np.ndarray:
    """Scores drawn, as logits, towards the mean of the page's blocks under the same tag path."""
    logit = np.log(np.clip(score, 1e-6, 1 - 1e-6) / np.clip(1 - score, 1e-6, 1))
    known: dict[bytes, int] = {}
    mates = np.array([known.setdefault(b.path, len(known)) for b in page])
    mean = np.bincount(mates, logit) / np.bincount(mates)
    return _sigmoid(own * logit + (1 - own) * mean[mates])


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), DIM), np.float32), np.zeros((steps, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, True
    return x, mask


# training pages

_CHROME = {
    "nav": ["nav", 'div class="menu"', 'div id="navigation"', 'ul class="nav"', 'div class="breadcrumbs"', 'div role="navigation"'],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="top-bar"'],
    "aside": ["aside", 'div class="sidebar"', 'div id="related"', 'div class="widget"', 'section class="related-posts"', 'div class="share social"'],
    "ad": ['div class="ad"', 'div class="advert banner"', 'div id="sponsored"', 'div class="ads promo"', 'section class="promo"'],
    "notice": ['div class="cookie-notice"', 'div id="consent"', 'div class="newsletter subscribe"', 'div class="alert notice"', 'div role="alert"'],
    "comments": ['div class="comments"', 'section id="comments"', 'div class="comment-list"', 'div class="reader-comments"', 'ol class="comment"'],
    "footer": ["footer", 'div class="footer"', 'div id="site-footer"', 'div class="copyright legal"'],
}
_MAIN = ["article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body entry"', 'section class="article text"', "div", "div"]
_CHROME_WORDS = "home login menu search share comment reply subscribe cookie cookies privacy policy terms copyright rights reserved contact newsletter accept ad sponsored buy offer next previous related read more tags follow posted by".split()


def sample_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A made-up page and, for each of its blocks in order, whether it belongs to the article."""
    syllables = ["".join(rng.choice(list("bcdfghlmnprstvw"), 1)) + "".join(rng.choice(list("aeiouéäóñ"), 1)) + ("" if rng.random() < 0.5 else "".join(rng.choice(list("nrst"), 1))) for _ in range(60)]
    labels: list[bool] = []
    pick = lambda seq: seq[int(rng.integers(len(seq)))]

    # some pages shout, some stick marks to every word, some have hardly any punctuation
    style = rng.random()
    marks = pick(["!!", "***", "###", "%%%", "&amp;&amp;", "$$", " |", "..."])

    def words(n: int, chrome: float = 0.0) -> str:
        out = [pick(_CHROME_WORDS) if rng.random() < chrome else "".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]
        if style < 0.12:
            out = [w.upper() for w in out]
        if style < 0.06 or 0.12 <= style < 0.2:
            out = [w + marks for w in out]
        return " ".join(out)

    def sentence(n: int, chrome: float = 0.0) -> str:
        text = words(n, chrome)
        return text[:1].upper() + text[1:] + pick([".", ".", ".", "!", "?", ""])

    def say(tag: str, content: str, main: bool, close: bool = True) -> str:
        labels.append(main)
        return f"<{tag}>{content}" + (f"</{tag.split()[0]}>" if close else "")

    def chrome(kind: str) -> str:
        outer = pick(_CHROME[kind])
        close = f"</{outer.split()[0]}>"
        if kind in ("ad", "footer", "notice") and rng.random() < 0.5:  # text directly inside the container
            return say(outer, pick(["&copy; ", ""]) + " ".join(sentence(int(rng.integers(2, 20)), 0.1) for _ in range(int(rng.integers(1, 3)))), False)
        inner = []
        for _ in range(int(rng.integers(1, 7))):
            form = rng.random()
            if kind in ("nav", "aside") and form < 0.7 or form < 0.15:
                inner.append(say("li", f'<a href="/{words(1)}">{words(int(rng.integers(1, 5)), 0.2)}</a>', False))
            elif kind == "comments":
                inner.append(say("p", sentence(int(rng.integers(3, 40)), 0.05), False))
            elif form < 0.3:
                inner.append(f'<form>{say("label", words(2, 0.5), False)}<input name="q">{say("button", words(1, 0.9), False)}</form>')
            else:
                inner.append(say(pick(["p", "div", "h3"]), sentence(int(rng.integers(2, 30)), 0.25), False))
        return f"<{outer}>{''.join(inner)}{close}"

    title = words(int(rng.integers(3, 9))).capitalize()
    labels.append(False)
    page = [f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>"]
    for kind in ("header", "nav", "notice", "ad"):
        if rng.random() < {"nav": 0.85, "ad": 0.6}.get(kind, 0.35):
            page.append(chrome(kind))
    outer = pick(_MAIN)
    body = []
    if rng.random() < 0.85:
        body.append(say("h1", title, True))
    for i in range(int(rng.integers(1, 16)) if rng.random() < 0.8 else int(rng.integers(16, 60))):
        form = rng.random()
        length = int(rng.integers(1, 6)) if rng.random() < 0.15 else int(rng.integers(6, 120))
        text = " ".join(sentence(max(1, length // k)) for k in [int(rng.integers(1, 6))] for _ in range(k))
        if form < 0.1:
            body.append(say("h2", words(int(rng.integers(1, 7))).capitalize(), True))
        elif form < 0.16:
            body.append("<ul>" + "".join(say("li", sentence(int(rng.integers(2, 20))), True) for _ in range(3)) + "</ul>")
        elif form < 0.18:
            body.append(say("blockquote", text, True))
        elif form < 0.22:
            body.append(say("pre", text, True))
        elif form < 0.26:
            rows = ("<tr>" + "".join(say(pick(["td", "td", "th"]), words(int(rng.integers(1, 6))), True) for _ in range(int(rng.integers(1, 4)))) + "</tr>" for _ in range(int(rng.integers(1, 5))))
            body.append("<table>" + "".join(rows) + "</table>")
        elif form < 0.34:
            body.append(say("p", f"<b>{text}<br>", True, close=False))
        elif form < 0.4:  # one word or a short phrase over and over
            body.append(say("p", " ".join([sentence(int(rng.integers(1, 8)))] * int(rng.integers(2, 40))), True))
        elif form < 0.46 and outer.startswith("div"):
            body.append(say("div", text, True))
        else:
            body.append(say("p", text.replace(" ", f' <a href="/x">{words(1)}</a> ', 1) if rng.random() < 0.15 else text, True))
        if i and rng.random() < 0.06:
            body.append(chrome(pick(["ad", "notice"])))
    page.append(f"<{outer}>{''.join(body)}</{outer.split()[0]}>")
    for kind in ("comments", "aside", "ad", "footer"):
        if rng.random() < {"footer": 0.85, "aside": 0.45}.get(kind, 0.35):
            page.append(chrome(kind))
    return "".join(page) + pick(["</body></html>", ""]), labels


@functools.cache
def trained(pages: int = 900, epochs: int = 9, seed: int = 11) -> Labeller:
    """The labeller, trained on made-up pages (once per process)."""
    rng = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        page, labels = sample_page(rng)
        found = blocks(page)
        if len(found) == len(labels):
            x = features(found)
            if rng.random() < 0.06:  # markup that says nothing: only words, measures and context
                x[:, :PATH_DIM] *= rng.random(PATH_DIM) < 0.5
            data.append((x, np.array(labels, np.float32)))
    data.sort(key=lambda d: len(d[0]))
    model = Labeller()
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(p) for k, p in model.p.items()}
    groups = [data[i : i + 24] for i in range(0, len(data), 24)]
    t = 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = _padded([d[0] for d in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, label) in enumerate(groups[g]):
                y[: len(label), k] = label
            t += 1
            for k, grad in model.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                model.p[k] = (model.p[k] - 0.01 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def article_text(pages: list[str | None], model: Labeller, threshold: float = 0.5) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, s in zip(bs, scores) if s >= threshold) for bs, scores in zip(found, model.label(found))]


def extract(pages: DataFrame, model: Labeller | None = None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if not given), ``text`` and ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # a few ten thousand numbers

    def compute(inputs):
        text = article_text(inputs[0].to_pylist(), shared.value)
        return [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]

    return append_columns(pages, keep, [F.col(html_col)], compute, "text string, n_chars long", 4 << 20)
