"""Main text of web pages: a bidirectional LSTM labels every block with the whole page in view.

A page becomes the sequence of its leaf blocks. A block is described by its tag path (names, classes
and ids of the elements around it, hashed), by its words (hashed), and by a few numbers (length, share
of linked text, place). The network is trained here, on a bounded sample of the pages themselves: the
elements that pages use to mark their article and their surroundings give the labels, and copies of
these pages rebuilt with other common markup keep it from leaning on one element name.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm import words

PATH_DIMS, WORD_DIMS, HIDDEN = 96, 32, 16
#: Pages to train on, each of at most so many bytes; a hash of the page picks them.
SAMPLE, SAMPLE_BYTES = 250, 500_000
EPOCHS, RATE, BATCH, SPAN = 14, 0.02, 24, 120

#: Elements whose content is no markup: they end at their own end tag alone, or with the page.
_RAW = frozenset("script style title textarea iframe".split())
_OPENING = re.compile(r"<(?:(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)|!--|[!?/])")
_MARK = re.compile("[>\"']")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in _RAW}
#: In SVG and MathML these elements are like others; their text is left out up to the end of the picture at most.
_INNER_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|(?=</(?:svg|math)[\s/>])", re.I) for tag in _RAW}
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SAME = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option", "button": "button"}
#: Elements whose text makes blocks of its own and leaves the text around them in one piece.
_APART = frozenset("template noscript object svg select button".split())
#: Whether the content of an element is SVG or MathML, where "/>" ends an element; others are as what they stand in.
_FOREIGN = {"svg": True, "math": True, "foreignobject": False, "desc": False, "annotation-xml": False}
#: Elements that, besides _BLOCKS, end an SVG or MathML element left open.
_BREAK_OUT = frozenset("b big br code em embed i img meta nobr ruby s small span strike strong sub sup tt u var".split())


class _Tokens:
    """Tags, comments and declarations of a page, one after another, in time that grows with its length.

    A tag ends at the next ">" outside quotes or, where quotes leave none, at the next ">" whatever they
    say; a comment at its "-->" or with the page. A "<" with no ">" behind it begins nothing.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: dict[int, int] = {}  # of places already passed, outside quotes

    def _unquoted(self, at: int) -> int:
        page, passed, end = self.page, [], -1
        while m := _MARK.search(page, at):
            at = m.start()
            if at in self.ends:
                end = self.ends[at]
                break
            passed.append(at)
            if page[at] == ">":
                end = at
                break
            closing = page.find(page[at], at + 1)
            if closing < 0:
                break
            at = closing + 1
        self.ends.update(dict.fromkeys(passed, end))
        return end

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start and end of the first token from ``at`` on, "/" of an end tag, name (empty for no tag) and
        attributes; None where only text is left."""
        page = self.page
        begin = page.find("<", at)
        if begin < 0:
            return None
        m = _OPENING.search(page, begin, self.last + 1) if begin < self.last else None
        if m is None or m.start() > self.last:
            start = page.find("<!--", begin)
            return None if start < 0 else (start, len(page), "", "", "")
        start = m.start()
        if m["tag"]:
            end = self._unquoted(m.end())
            if end < 0:
                end = page.find(">", m.end())
            return start, end + 1, m["close"], m["tag"].lower(), page[m.end() : end]
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            return start, len(page) if end < 0 else end + 3, "", "", ""
        return start, page.find(">", m.end()) + 1, "", "", ""


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, with decoded text, white space turned into one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[str] = []
    after: list[Block] = []  # blocks from inside the one being read
    linked = links = 0
    path: tuple[str, ...] = ()
    held: list[tuple] = []  # what was being read where an element of _APART began
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()  # raw elements in a picture without an end in the rest of the page

    def end() -> None:
        nonlocal linked, path
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            parts.clear()
        out.extend(after)
        after.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal path, linked
        if text:
            if not parts:
                if text.isspace():
                    return
                path = tuple(t for _, names, _ in stack for t in names)
            parts.append(text)
            if links:
                linked += len(text)

    def pop(to: int) -> None:
        nonlocal out, parts, after, linked, links, path
        while held and held[-1][0] >= to:
            end()
            inner = out
            _, out, parts, after, linked, path = held.pop()
            (after if parts else out).extend(inner)
        links -= sum(tag == "a" for tag, _, _ in stack[to:])
        opened.subtract(tag for tag, _, _ in stack[to:])
        del stack[to:]

    page, at = page or "", 0
    tokens = _Tokens(page)
    while token := tokens.next(at):
        start, ended, close, tag, attrs = token
        add(page[at:start])
        at = ended
        if not tag:
            continue
        foreign = bool(stack) and stack[-1][2]
        if foreign and not close and (tag in _BLOCKS or tag in _BREAK_OUT):
            to = len(stack) - 1
            while to and stack[to - 1][2]:
                to -= 1
            pop(to)
            foreign = False
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in _BLOCKS:
            end()
        if close:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    pop(i)
                    if tag in _BLOCKS:
                        end()
                    break
        elif (foreign or tag in ("svg", "math")) and attrs.endswith("/"):
            continue
        elif tag in _RAW:
            closing = None if tag in unclosed else (_INNER_END if foreign else _RAW_END)[tag].search(page, at)
            if closing or not foreign:
                at = closing.end() if closing else len(page)
            else:
                unclosed.add(tag)
        elif tag not in _VOID:
            for i in range(len(stack) - 1, -1, -1) if tag in _BLOCKS or tag in _SAME else ():
                open_tag = stack[i][0]
                if tag in _BLOCKS and open_tag == "p" or open_tag in (tag, _SAME.get(tag)) and tag in _SAME:
                    pop(i)
                    break
                if open_tag in _APART or open_tag in _BLOCKS and open_tag != "p":
                    break
            names = [tag]
            if attrs:
                for value in _NAMED.findall(attrs):
                    names += ["." + w for w in re.findall(r"[a-z]+", value.lower())]
            if tag in _APART:
                held.append((len(stack), out, parts, after, linked, path))
                out, parts, after, linked = [], [], [], 0
            links += tag == "a"
            opened[tag] += 1
            stack.append((tag, tuple(names), _FOREIGN.get(tag, foreign)))
    # A "<" that begins nothing is text.
    add(page[at:])
    pop(0)
    end()
    return out


#: Names by which markup tells an article from what surrounds it.
ARTICLE = ("article", "main", ".article", ".content", ".post", ".entry", ".story", ".main", ".body")
AROUND = ("nav", "header", "footer", "aside", "form", "menu", "dialog", ".ad", ".ads", ".advert", ".advertisement", ".banner",
          ".breadcrumb", ".comment", ".comments", ".consent", ".cookie", ".copyright", ".footer", ".form", ".header", ".login", ".menu",
          ".nav", ".navbar", ".navigation", ".newsletter", ".notice", ".pagination", ".popup", ".promo", ".related", ".replies",
          ".search", ".share", ".sidebar", ".social", ".sponsor", ".sponsored", ".subscribe", ".tags", ".toolbar", ".widget")
_ARTICLE, _AROUND = frozenset(ARTICLE), frozenset(AROUND)


def marked(path: tuple[str, ...]) -> bool | None:
    """What a path says by itself: in the article, around it, or nothing."""
    if any(t in _AROUND for t in path):
        return False
    return True if any(t in _ARTICLE for t in path) else None


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed names of a path, each once, and its last element once more in a part of its own."""
    if path not in _PATHS:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        out = np.zeros(PATH_DIMS, np.float32)
        names = sorted(set(path))
        for h in np.concatenate([np.zeros(0, np.uint64), *words.hash_list(["x" + n.replace(".", "class") for n in names])]).tolist():
            out[h % (PATH_DIMS - 16)] = 1
        if path:
            out[PATH_DIMS - 16 + words.hash_list(["x" + path[-1].replace(".", "class")])[0][0] % 16] = 1
        _PATHS[path] = out
    return _PATHS[path]


NUMBERS = 8


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row a block, pages one after another."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), PATH_DIMS + WORD_DIMS + NUMBERS), np.float32)
    if not flat:
        return out
    row = 0
    for first, stop, data, text_start in words.slices(pa.array([b.text for b in flat], pa.large_string())):
        found = words.split(data, text_start, "alnum")
        n = np.diff(found.first)
        of = np.repeat(np.arange(stop - first), n)
        bag = np.bincount(of * WORD_DIMS + (words.hashes(found) % np.uint64(WORD_DIMS)).astype(np.int64), minlength=(stop - first) * WORD_DIMS)
        bag = 0.3 * bag.reshape(-1, WORD_DIMS) / np.maximum(1, np.linalg.norm(bag.reshape(-1, WORD_DIMS), axis=1))[:, None]
        out[first:stop, PATH_DIMS : PATH_DIMS + WORD_DIMS] = bag
        out[first:stop, -8] = np.log1p(n) / 5
        out[first:stop, -7] = [min(1.0, b.linked / len(b.text)) for b in flat[first:stop]]
        out[first:stop, -6] = [b.text[-1] in ".!?…\"”" for b in flat[first:stop]]
        out[first:stop, -5] = n > 12
    for page in pages:
        k = len(page)
        for i, b in enumerate(page):
            out[row + i, :PATH_DIMS] = _path_vector(b.path)
        place = np.arange(k, dtype=np.float32)
        out[row : row + k, -4] = place / max(1, k)
        out[row : row + k, -3] = place == 0
        out[row : row + k, -2] = place == k - 1
        out[row : row + k, -1] = 1
        row += k
    return out


class Net(NamedTuple):
    """Weights of both directions (inputs and state side by side; gates: in, forget, out, new) and the output."""

    ahead: np.ndarray
    back: np.ndarray
    out: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(x: np.ndarray, on: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction. ``x``: steps, pages, inputs; ``on``: which steps a page has."""
    steps, n, d = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((steps, n, HIDDEN), np.float32)
    from_input = (x.reshape(-1, d) @ w[:d]).reshape(steps, n, -1)
    for t in range(steps):
        z = from_input[t] + h @ w[d:]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        mask = on[t][:, None]
        new_c = np.where(mask, f * c + i * g, c)
        tanh_c = np.tanh(new_c)
        new_h = np.where(mask, o * tanh_c, h)
        if keep is not None:
            keep.append((h, c, i, f, o, g, tanh_c))
        h, c = new_h, new_c
        out[t] = h
    return out


def _back(x: np.ndarray, on: np.ndarray, w: np.ndarray, keep: list, dout: np.ndarray) -> np.ndarray:
    """Gradient of the weights of one direction."""
    steps, n, d = x.shape
    grad = np.zeros_like(w)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    gates = np.zeros((steps, n, 4 * HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tanh_c = keep[t]
        mask = on[t][:, None]
        total = dh + dout[t]
        live = np.where(mask, total, 0)
        dc_now = np.where(mask, dc + live * o * (1 - tanh_c**2), 0)
        dz = np.concatenate([dc_now * g * i * (1 - i), dc_now * c * f * (1 - f), live * tanh_c * o * (1 - o), dc_now * i * (1 - g**2)], axis=1)
        gates[t] = dz
        grad[d:] += h.T @ dz
        dh = np.where(mask, dz @ w[d:].T, total)
        dc = np.where(mask, dc_now * f, dc)
    grad[:d] = x.reshape(-1, d).T @ gates.reshape(-1, 4 * HIDDEN)
    return grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    on = np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], on[: len(p), j] = p, True
    return x, on


def _turned(x: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse, still from step 0 on."""
    n = on.sum(0)
    at = n[None] - 1 - np.arange(len(x))[:, None]
    return np.where((at >= 0)[..., None], x[np.maximum(at, 0), np.arange(x.shape[1])[None]], 0)


def probabilities(net: Net, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Chance of each block to be main text. Pages of like length go together, to keep padding small."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((j for j in range(len(pages)) if len(pages[j])), key=lambda j: len(pages[j]))
    at = 0
    while at < len(order):
        stop = at
        while stop < len(order) and (stop - at + 1) * len(pages[order[stop]]) <= 20_000 or stop == at:
            stop += 1
        group = order[at:stop]
        x, on = _padded([pages[j] for j in group])
        ahead = _run(x, on, net.ahead)
        back = _turned(_run(_turned(x, on), on, net.back), on)
        p = _sigmoid(ahead @ net.out[:HIDDEN] + back @ net.out[HIDDEN:-1] + net.out[-1])
        for k, j in enumerate(group):
            out[j] = p[: len(pages[j]), k]
        at = stop
    return out


def train_net(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 0) -> Net:
    """Adam on the mean log loss of labelled blocks (labels 0, 1; below 0: none)."""
    rng = np.random.default_rng(seed)
    d = PATH_DIMS + WORD_DIMS + NUMBERS
    net = [rng.normal(0, 0.1, (d + HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
    net.append(np.concatenate([rng.normal(0, 0.1, 2 * HIDDEN), [0]]).astype(np.float32))
    for w in net[:2]:
        w[d - 1, HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
    first, second, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(pages))
        for at in range(0, len(order), BATCH):
            group = order[at : at + BATCH]
            x, on = _padded([pages[j] for j in group])
            y = np.full(on.shape, -1.0, np.float32)
            for k, j in enumerate(group):
                y[: len(labels[j]), k] = labels[j]
            known = (y >= 0) & on
            rx = _turned(x, on)
            keep_a: list = []
            keep_b: list = []
            ahead, turned = _run(x, on, net[0], keep_a), _run(rx, on, net[1], keep_b)
            back = _turned(turned, on)
            p = _sigmoid(ahead @ net[2][:HIDDEN] + back @ net[2][HIDDEN:-1] + net[2][-1])
            dz = np.where(known, p - y, 0).astype(np.float32) / max(1, known.sum())
            grad_out = np.concatenate([np.einsum("tn,tnh->h", dz, ahead), np.einsum("tn,tnh->h", dz, back), [dz.sum()]])
            grads = [_back(x, on, net[0], keep_a, dz[..., None] * net[2][:HIDDEN]),
                     _back(rx, on, net[1], keep_b, _turned(dz[..., None] * net[2][HIDDEN:-1], on)), grad_out.astype(np.float32)]
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for k, g in enumerate(grads):
                g = g * min(1.0, 5 / max(norm, 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Net(*net)


_PLACES = (("html", "body", "article"), ("html", "body", "main"), ("html", "body", "main", "article"), ("html", "body", "div", ".content"),
           ("html", "body", "div", ".post"), ("html", "body", "div", ".main", "div", ".entry"), ("html", "body", "div", ".article", ".body"),
           ("html", "body", "section", ".story"), ("html", "body", "div", ".page", "article", ".post"), ("html", "body"),
           ("html", "body", "div"), ())
_LEAVES = (("p",), ("ul", "li"), ("ul", "li"), ("ol", "li"), ("h2",), ("h3",), ("blockquote",), ("table", "tr", "td"), ("div",), ("pre",), ())


def rebuilt(page: list[Block], label: list[bool | None], pool: list[Block], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The same article in another common frame, with more of what pages put around and into articles."""
    place = _PLACES[rng.integers(len(_PLACES))]
    body = [b for b, v in zip(page, label, strict=True) if v]
    around = [b for b, v in zip(page, label, strict=True) if v is False]
    out: list[tuple[Block, int]] = []

    def side(count: int, inside: tuple[str, ...]) -> None:
        for _ in range(count):
            name = AROUND[rng.integers(len(AROUND))]
            own = (name,) if not name.startswith(".") else (("div", "section", "ul")[rng.integers(3)], name)
            for _ in range(int(rng.integers(1, 5))):
                source = pool[rng.integers(len(pool))]
                leaf = (("p",), ("li", "a"), ("li",), ("div",), ("span",), ("h1",), ("h2",))[rng.integers(7)]
                tokens = source.text.split()
                cut = int(rng.integers(1, 4 + len(tokens) if rng.random() < 0.4 else 12))
                text = " ".join(tokens[:cut])
                out.append((Block((*inside, *own, *leaf), text, len(text) if "a" in leaf else 0), 0))

    alone = rng.random() < (0.5 if len(place) < 4 else 0.1)  # a page may be nothing but its article
    for b in around:
        if not alone and rng.random() < 0.5:
            out.append((b, 0))
    side(0 if alone else int(rng.integers(0, 4)), ("html", "body"))
    middle = int(rng.integers(0, len(body) + 1))
    for k, b in enumerate(body):
        if k == middle and rng.random() < 0.5:
            side(1, place)
        leaf, text = tuple(t for t in b.path if t in ("h1", "p", "b")), b.text
        if rng.random() < 0.4:  # list items, cells and short headings of the article
            leaf, tokens = _LEAVES[rng.integers(len(_LEAVES))], text.split()
            text = " ".join(tokens[: rng.integers(2, 10)]) if rng.random() < 0.5 else text
        out.append((Block((*place, *leaf), text, 0), 1))
    if rng.random() < 0.4:
        side(1, place)
    side(0 if alone else int(rng.integers(0, 4)), ("html", "body"))
    return [b for b, _ in out], np.array([v for _, v in out], np.float32)


def fit(pages: list[str], seed: int = 0) -> Net | None:
    """Train on pages whose markup tells article from surroundings, as they are and rebuilt."""
    rng = np.random.default_rng(seed)
    parsed = [b for b in map(blocks, pages) if b]
    labels = [[marked(b.path) for b in page] for page in parsed]
    pool = [b for page in parsed for b in page]
    sets: list[list[Block]] = []
    truth: list[np.ndarray] = []
    for page, label in zip(parsed, labels, strict=True):
        if any(label):
            # The given page counts twice, once without class names, and once in another frame.
            bare = [b._replace(path=tuple(t for t in b.path if t[0] != ".")) for b in page]
            given = np.array([-1 if v is None else float(v) for v in label], np.float32)
            sets += [page, bare]
            truth += [given, given]
            for _ in range(2):
                other, values = rebuilt(page, label, pool, rng)
                sets.append(other)
                truth.append(values)
    if not sets:
        return None
    x = vectors(sets)
    ends = np.cumsum([0, *map(len, sets)])
    cut = [(a + k, min(b, a + k + SPAN)) for a, b in zip(ends[:-1], ends[1:], strict=True) for k in range(0, b - a, SPAN)]
    flat = np.concatenate(truth)
    return train_net([x[a:b] for a, b in cut], [flat[a:b] for a, b in cut], seed=seed)


def extract(net: Net | None, pages: list[str | None]) -> list[str]:
    """Main texts. Without a network every block counts as main text."""
    parsed = [blocks(p) for p in pages]
    if net is None:
        return ["\n\n".join(b.text for b in page) for page in parsed]
    x = vectors(parsed)
    ends = np.cumsum([0, *map(len, parsed)])
    chance = probabilities(net, [x[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return ["\n\n".join(b.text for b, p in zip(page, c.tolist(), strict=True) if p >= 0.5) for page, c in zip(parsed, chance, strict=True)]


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Net | None:
    """Fit on about ``sample`` different pages; null and longer than SAMPLE_BYTES ones teach nothing.
    Copies of a page count once, so the pages do not depend on how often each occurs."""
    rows = pages.select(F.col(html_col).cast("string").alias("html")).where(f"html is not null and octet_length(html) <= {SAMPLE_BYTES}")
    rows = rows.withColumn("hash", F.xxhash64("html"))
    n = rows.select("hash").distinct().count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    place = F.pmod("hash", F.lit(1 << 30))
    picked = rows.where(place < share).dropDuplicates(["hash", "html"]).orderBy(place, "hash", "html").limit(4 * sample)
    return fit(sorted(r["html"] for r in picked.select("html").collect()))


def main_text(pages: DataFrame, net: Net | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row; ids and urls are carried as they are. A null or empty
    page, or one without main text, has an empty text. Equal rows get equal results."""
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = extract(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(run, "id long, url string, text string, n_chars long")
