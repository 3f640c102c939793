"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: stretches of text between block-level tags.  Each block is a vector of its hashed
tag path (tags, class and id words of all open block elements) and its hashed words; a numpy bidirectional LSTM reads
the whole sequence and gives every block the probability that it is main text.  The network is trained here, on a
bounded sample of pages whose own markup names the main part and on pages composed from their blocks in other layouts.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from watchtide.llm import common

SAMPLE_PAGES = 400  # pages that the network is fitted on, at most
COMPOSED = 500  # further training pages, composed from the blocks of the sample
PATH_SIZE, WORD_SIZE, HIDDEN = 96, 24, 16
EPOCHS = 6
CELLS = 60_000  # blocks, with padding, that go through the network at once

# HTML's block-level elements, and those whose content is not text of the page.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre
search section select summary table tbody td tfoot th thead tr ul""".split())
RAW_TEXT = "script|style|title|textarea|iframe"  # run to the end of the page where they are not closed
RAW = "script|style|title|textarea|template|noscript|iframe|svg|object|math|canvas|audio|video"
VOID = frozenset("hr".split())
ENDS_P = BLOCKS - {"button", "label", "legend", "option", "optgroup"}
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",)}
# Words by which markup names its parts, for the labels of the training sample.
MAIN = frozenset("article main".split())
NOISE = frozenset("""nav menu header footer aside sidebar ad ads advert advertisement banner sponsored promo notice cookie cookies consent
form login search subscribe newsletter comment comments reply replies related share social breadcrumb breadcrumbs pagination widget popup
modal copyright button select""".split())

_RAW_NAMES, _RAW_TEXT = frozenset(RAW.split("|")), frozenset(RAW_TEXT.split("|"))
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"[\"'>]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


class Step:
    """An open block element and those around it; what is asked of a path is worked out once for each step."""

    __slots__ = ("above", "text", "depth", "noise", "main", "vector")

    def __init__(self, above: Step | None, text: str):
        words = text.split(" ")
        self.above, self.text, self.depth, self.vector = above, text, above.depth + 1 if above else 0, None
        self.noise = above is not None and (above.noise or any(w in NOISE for w in words))
        self.main = above is not None and (above.main or any(w in MAIN for w in words))


ROOT = Step(None, "")


@dataclass
class Block:
    step: Step
    text: str
    linked: float  # share of its characters inside links


_attributes: dict[str, str] = {}


def _named(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role, as one path step."""
    if not attributes or "=" not in attributes:
        return tag
    step = _attributes.get(attributes)
    if step is None:
        words = [w.lower() for m in _NAMES.finditer(attributes) for w in _PART.findall(m[1])]
        step = " ".join(["", *words])
        if len(_attributes) > 20_000:
            _attributes.clear()
        _attributes[attributes] = step
    return tag + step


class _Scanner:
    """Tags of a page from front to back.  What was looked for in vain is remembered, so that the time is linear."""

    def __init__(self, page: str):
        self.page = page
        self.mark = (0, -1)  # no quote and no > between these places
        self.dead: set[int] = set()  # quotes from which no tag ends
        self.unclosed: dict[str, int] = {}  # raw elements without an end tag behind a place
        self.last = page.rfind(">")

    def tag_end(self, at: int) -> int:
        """Place behind the > that ends a tag, quoted ones aside; -1 if there is none."""
        seen = []
        while at <= self.last:
            if not self.mark[0] <= at <= self.mark[1]:
                found = _MARK.search(self.page, at)
                self.mark = (at, found.start())
            quote = self.mark[1]
            if self.page[quote] == ">":
                return quote + 1
            if quote in self.dead:
                break
            seen.append(quote)
            closing = self.page.find(self.page[quote], quote + 1)
            if closing < 0:
                break
            at = closing + 1
        self.dead.update(seen)
        return -1

    def raw_end(self, name: str, at: int) -> int:
        """Place behind the end tag of a raw element; -1 if there is none."""
        if self.unclosed.get(name, len(self.page)) <= at:
            return -1
        found = re.compile(rf"</{name}\s*>", re.I).search(self.page, at)
        if not found:
            self.unclosed[name] = at
            return -1
        return found.end()

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(start, end, closing, tag, attributes) of each tag; comments, raw elements and declarations have no name."""
        page, at = self.page, self.page.find("<")
        while at >= 0:
            if at > self.last:  # only comments may stay open
                at = page.find("<!--", at)
                if at < 0:
                    return
            end, closing, tag, attributes = -1, page.startswith("/", at + 1), "", ""
            name = _NAME.match(page, at + 2 if closing else at + 1)
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = end + 3 if end >= 0 else len(page)
            elif name:
                low = name[0].lower()
                if not closing and low in _RAW_NAMES:
                    end = page.find(">", name.end()) + 1
                    if page[end - 2] != "/" or end - 2 < name.end():
                        end = self.raw_end(low, end)
                        if end < 0 and low in _RAW_TEXT:
                            end = len(page)
                if end < 0:
                    end = self.tag_end(name.end())
                    if end >= 0:
                        tag, attributes = low, page[name.end():end - 1]
            if end < 0 and page[at + 1:at + 2] in ("!", "?", "/"):
                end = page.find(">", at + 1) + 1
            if end > 0:
                yield at, end, closing, tag, attributes
            at = page.find("<", end if end > 0 else at + 1)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, with character references decoded and white space collapsed; none without text."""
    found: list[Block] = []
    path: list[tuple[str, Step]] = []
    open_tags: Counter = Counter()
    parts: list[str] = []
    links, linked, at, page = 0, 0, 0, page or ""

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(path[-1][1] if path else ROOT, text, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def pop() -> str:
        tag = path.pop()[0]
        open_tags[tag] -= 1
        return tag

    for start, end, closing, tag, attributes in _Scanner(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            linked += len(piece) if links else 0
        at = end
        if not tag:
            continue
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        close()
        if closing:
            if open_tags[tag]:
                while pop() != tag:
                    pass
        else:
            if path and path[-1][0] == "p" and tag in ENDS_P:
                pop()
            ends = SAME_ENDS.get(tag, ())
            while path and path[-1][0] in ends:
                pop()
            if tag not in VOID and not attributes.endswith("/"):
                path.append((tag, Step(path[-1][1] if path else ROOT, _named(tag, attributes))))
                open_tags[tag] += 1
        links = 0
    if at < len(page):
        parts.append(page[at:])
    close()
    return found


def named_label(block: Block) -> bool | None:
    """What the markup itself says of a block: main text, not main text, or nothing (None)."""
    return False if block.step.noise else True if block.step.main else None


class Features:
    """Vectors of blocks; word buckets are remembered, path vectors are kept at the steps."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def path(self, step: Step) -> np.ndarray:
        waiting = []
        while step.vector is None and step.above is not None:
            waiting.append(step)
            step = step.above
        known = np.zeros(PATH_SIZE, np.float32) if step.vector is None else step.vector
        for step in reversed(waiting):
            step.vector = known = known.copy()
            for word in step.text.split(" "):
                known[_bucket(word, PATH_SIZE - 1)] = 1
        return known

    def __call__(self, page: list[Block], first: bool = True, last: bool = True) -> np.ndarray:
        """``page`` may be a stretch of a page; ``first`` and ``last`` say whether it holds the page's ends."""
        out = np.zeros((len(page), PATH_SIZE + WORD_SIZE + 5), np.float32)
        for i, block in enumerate(page):
            words = block.text.split(" ")
            if len(self.words) > 200_000:
                self.words.clear()
            for w in words:
                if w not in self.words:
                    self.words[w] = _bucket(w.lower(), WORD_SIZE)
            counts = np.bincount([self.words[w] for w in words], minlength=WORD_SIZE)
            out[i, :PATH_SIZE] = self.path(block.step)
            if block.step.depth:
                out[i, _bucket("leaf " + block.step.text.split(" ")[0], PATH_SIZE - 1)] += 1
            out[i, PATH_SIZE - 1] = block.step.depth / 8
            out[i, PATH_SIZE:PATH_SIZE + WORD_SIZE] = np.sqrt(counts / len(words))
            out[i, -5:] = (np.log1p(len(words)) / 4, block.linked, block.text[-1] in ".!?…", first and i == 0, last and i == len(page) - 1)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence of (B, T, ...) backwards within its own length; undoes itself."""
    steps = np.arange(x.shape[1])[None, :]
    at = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
    return x[np.arange(len(x))[:, None], at]


def _pass(w: dict, way: str, x: np.ndarray, keep: bool, begin: tuple | None = None):
    """States (B, T, h) of one direction over (B, T, d); padding lies behind the sequence and is never looked at."""
    h = w["U" + way].shape[0]
    inputs = x @ w["W" + way] + w["b" + way]
    state, cell = begin or np.zeros((2, len(x), h), np.float32)
    out, kept = np.zeros((len(x), x.shape[1], h), np.float32), []
    for t in range(x.shape[1]):
        gates = inputs[:, t] + state @ w["U" + way]
        i, f, o = np.split(_sigmoid(gates[:, :3 * h]), 3, axis=1)
        g = np.tanh(gates[:, 3 * h:])
        before, cell = cell, f * cell + i * g
        squashed = np.tanh(cell)
        if keep:
            kept.append((state, before, i, f, o, g, squashed))
        state = o * squashed
        out[:, t] = state
    return out, kept, (state, cell)


def _forward(w: dict, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    ahead, kept_f, _ = _pass(w, "f", x, keep)
    back, kept_b, _ = _pass(w, "b", _turned(x, lengths), keep)
    both = np.concatenate([ahead, _turned(back, lengths)], axis=2)
    return _sigmoid(both @ w["v"] + w["c"]), both, kept_f, kept_b


def _gradients(w: dict, x: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> dict:
    p, both, kept_f, kept_b = _forward(w, x, lengths, True)
    mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
    d = ((p - target) * mask / mask.sum()).astype(np.float32)
    h = w["Uf"].shape[0]
    g = {"v": np.tensordot(both, d, axes=((0, 1), (0, 1))), "c": d.sum(keepdims=True).reshape(1)}
    d_both = d[:, :, None] * w["v"]
    for way, kept, given, d_out in (("f", kept_f, x, d_both[:, :, :h]), ("b", kept_b, _turned(x, lengths), _turned(d_both[:, :, h:], lengths))):
        d_gates = np.zeros((*x.shape[:2], 4 * h), np.float32)
        d_state, d_cell = np.zeros((2, len(x), h), np.float32)
        g["U" + way] = np.zeros_like(w["U" + way])
        for t in range(x.shape[1] - 1, -1, -1):
            state, before, i, f, o, cand, squashed = kept[t]
            ds = d_state + d_out[:, t]
            dc = d_cell + ds * o * (1 - squashed * squashed)
            step = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - cand * cand)], axis=1)
            d_gates[:, t] = step
            g["U" + way] += state.T @ step
            d_state, d_cell = step @ w["U" + way].T, dc * f
        g["W" + way], g["b" + way] = np.tensordot(given, d_gates, axes=((0, 1), (0, 1))), d_gates.sum(axis=(0, 1))
    return g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), int(lengths.max()), pages[0].shape[1]), np.float32)
    for i, p in enumerate(pages):
        x[i, :len(p)] = p
    return x, lengths


def probabilities(w: dict, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of main text for each block of each page; pages of like length go together, in bounded batches."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: -len(pages[i]))
    while order:
        take = max(1, CELLS // len(pages[order[0]]))
        some, order = order[:take], order[take:]
        p = _forward(w, *_padded([pages[i] for i in some]))[0]
        for i, row in zip(some, p):
            out[i] = row[:len(pages[i])]
    return out


def long_probabilities(w: dict, page: list[Block], features: Features, stretch: int = CELLS) -> np.ndarray:
    """The same for one page of any number of blocks: both directions go over its stretches and hand on their states."""
    n, h = len(page), w["Uf"].shape[0]
    score = np.full(n, w["c"][0], np.float32)
    for way, weight, starts in (("f", w["v"][:h], range(0, n, stretch)), ("b", w["v"][h:], range((n - 1) // stretch * stretch, -1, -stretch))):
        state = None
        for at in starts:
            x = features(page[at:at + stretch], at == 0, at + stretch >= n)[None]
            out, _, state = _pass(w, way, x if way == "f" else x[:, ::-1], False, state)
            score[at:at + stretch] += (out[0] if way == "f" else out[0, ::-1]) @ weight
    return _sigmoid(score)


# Layouts of composed training pages.
_MAIN_SHELLS = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>',
                '<div id="main-content"><div class="post">{}</div></div>', '<section class="article-body">{}</section>', '<div class="entry">{}</div>',
                '<div class="wrapper"><article class="story">{}</article></div>']
_NOISE_SHELLS = ["<nav><ul>{links}</ul></nav>", '<div class="menu"><ul>{links}</ul></div>', "<header><p>{text}</p></header>", '<div class="header">{text}</div>',
                 '<div class="ad">{text}</div>', '<div class="advert banner"><p>{text}</p></div>', '<div class="sponsored">{text}</div>',
                 '<aside><h3>{text}</h3><ul>{links}</ul></aside>', '<div class="sidebar"><p>{text}</p><ul>{links}</ul></div>', '<div class="cookie-notice">{text}</div>',
                 '<div class="notice">{text}</div>', '<form action="/s"><label>{text}</label><input name="q"><button>{text}</button></form>',
                 '<section class="comments"><h2>{text}</h2><div class="comment"><p>{long}</p></div><div class="comment"><p>{long}</p></div></section>',
                 '<div id="comments"><ul><li class="comment"><p>{long}</p></li></ul></div>', '<div class="related"><ul>{links}</ul></div>',
                 '<div class="share social">{links}</div>', "<footer>&copy; {text}</footer>", '<div class="footer"><p>{text}</p></div>',
                 '<div class="newsletter"><form><p>{text}</p></form></div>', '<ol class="breadcrumb">{links}</ol>']


def compose(rng: random.Random, texts: list[str]) -> str:
    """A page in a random layout, with its main part between the control characters 2 and 3."""
    def pick(most: int) -> str:
        words = rng.choice(texts).split()
        return html.escape(" ".join(words[:rng.randint(1, most)]))

    def noise() -> str:
        links = "".join(f'<li><a href="/x">{pick(2)}</a></li>' for _ in range(rng.randint(2, 7)))
        return rng.choice(_NOISE_SHELLS).replace("{links}", links).replace("{text}", pick(14)).replace("{long}", pick(50))

    body = []
    for i in range(rng.randint(1, 14)):
        whole = html.escape(rng.choice(texts)) if rng.random() < 0.7 else pick(12)
        kind = "h1" if i == 0 and rng.random() < 0.8 else rng.choice(["p", "p", "p", "p", "p", "h2", "h3", "blockquote", "li", "pre", "td"])
        if kind in ("h1", "h2", "h3"):
            whole = pick(10)
        shell = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}.get(kind, f"<{kind}>{{}}</{kind}>")
        body.append(shell.replace("{}", whole) if rng.random() < 0.85 or kind != "p" else f"<p><b>{whole}<br>")
        if rng.random() < 0.12:
            body.append(rng.choice(['<div class="ad">{}</div>', "<aside><p>{}</p></aside>", '<div class="share">{}</div>', "<form><p>{}</p></form>"]).replace("{}", pick(12)))
    inside = rng.choice(_MAIN_SHELLS).replace("{}", "\x02" + "".join(body) + "\x03")
    ahead, behind = "".join(noise() for _ in range(rng.randint(0, 4))), "".join(noise() for _ in range(rng.randint(0, 4)))
    return f"<html><head><title>{pick(9)}</title></head><body>{ahead}{inside}{behind}</body></html>"


def _composed(rng: random.Random, texts: list[str]) -> tuple[list[Block], np.ndarray]:
    page = compose(rng, texts)
    before, _, rest = page.partition("\x02")
    main, _, _ = rest.partition("\x03")
    first, upto = len(blocks(before)), len(blocks(before + main))
    found = blocks(page.replace("\x02", "").replace("\x03", ""))
    label = np.zeros(len(found), np.float32)
    for i in range(first, min(upto, len(found))):
        label[i] = not found[i].step.noise
    return found, label


def fit(pages: list[str], seed: int = 11) -> dict:
    """Weights from sample pages; without any page whose markup names its main part, from composed pages alone."""
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    features, data, texts = Features(), [], []
    for page in pages:
        found = blocks(page)
        labels = [named_label(b) for b in found]
        if any(labels):
            data.append((features(found), np.array([x is True for x in labels], np.float32)))
            texts += [b.text for b, x in zip(found, labels) if x]
    texts = texts or ["A plain line of text that stands for any other.", "Short.", "One more line, a little longer than the one before it."]
    for _ in range(COMPOSED):
        found, label = _composed(rng, texts)
        if found:
            data.append((features(found), label))
    d, h = PATH_SIZE + WORD_SIZE + 5, HIDDEN
    w = {"v": draw.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
    for way in "fb":
        w["W" + way], w["U" + way], w["b" + way] = draw.normal(0, 0.2, (d, 4 * h)), draw.normal(0, 1 / np.sqrt(h), (h, 4 * h)), np.zeros(4 * h)
    w = {k: v.astype(np.float32) for k, v in w.items()}
    mean, var, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    data.sort(key=lambda x: len(x[0]))
    batches = []
    for i in range(0, len(data), 24):
        x, lengths = _padded([f for f, _ in data[i:i + 24]])
        target = np.zeros(x.shape[:2], np.float32)
        for k, (_, label) in enumerate(data[i:i + 24]):
            target[k, :len(label)] = label
        batches.append((x, lengths, target))
    for epoch in range(EPOCHS):
        for i in draw.permutation(len(batches)):
            step += 1
            for k, g in _gradients(w, *batches[i]).items():  # Adam
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                rate = 0.02 / (1 + epoch)
                w[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return w


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, html_col: str = "html", id_col: str = "page_id") -> dict:
    """Fit on at most ``sample_pages`` pages, those with the smallest id hash."""
    known = pages.where(F.col(html_col).isNotNull())
    ids = known.select(F.col(id_col).alias("of")).distinct().orderBy(F.xxhash64("of"), "of").limit(sample_pages)
    rows = known.join(F.broadcast(ids), F.col(id_col) == F.col("of")).select(html_col).limit(2 * sample_pages).collect()  # the bounded sample
    return fit(sorted(r[0] for r in rows))


def extract(pages: DataFrame, weights: dict, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_blocks, n_kept) per row: the blocks labelled main text, in page order, one per line.

    A page that is null, empty or without main text gives the empty text.  Other columns are ignored.
    """

    def make():
        features = Features()

        def run(found: list[str | None]) -> tuple[None, list]:
            parsed = [blocks(page) for page in found]
            short = iter(probabilities(weights, [features(f) for f in parsed if len(f) <= CELLS]))
            chosen = [next(short) if len(f) <= CELLS else long_probabilities(weights, f, features) for f in parsed]
            kept = [[b.text for b, x in zip(f, p) if x > 0.5] for f, p in zip(parsed, chosen)]
            return None, [["\n".join(k) for k in kept], [len(f) for f in parsed], [len(k) for k in kept]]

        return run

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return common.map_column(slim, "html", "text string, n_blocks int, n_kept int", make, rows=300)
