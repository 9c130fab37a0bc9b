"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags, with the path
of open tags). A bidirectional LSTM in numpy reads, block by block, hashed
vectors of the tag path and of the words and a few measures, and labels every
block main text or not with the whole page as context.

The labeller is trained here, on at most ``TRAIN_PAGES`` pages (the smallest by
a hash of the id; a documented bound), from weak labels: blocks below article
or main elements are positive; blocks below navigation, header, footer, aside,
form and similar elements, or of elements whose class or id names such a part,
are negative; all others teach nothing. At use every block of every page is
labelled by the network alone, whatever its tags; sequences are never cut.

Text: character references decoded, white space inside a block one space,
trimmed, blocks in page order joined by two newlines. Null and empty pages and
pages without main text give the empty text. Repeated rows give repeated
results. With no page to learn from, all blocks outside the head count.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import ship, slices, span_hashes, word_bounds

PATH_DIMS = 48
WORD_DIMS = 24
MEASURES = 4
INPUTS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16
TRAIN_PAGES = 400
TRAIN_BLOCKS = 96  # a longer training page teaches in pieces of this length, four at most
CELLS = 60_000  # padded blocks labelled at once

# Fixed element lists of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe textarea".split()
# HTML elements that end a drawing (svg) around them: with one of these inside, or unclosed, it doesn't go whole.
ENDING = ("blockquote body center dd div dl dt em embed h[1-6] head hr img li menu ol p pre ruby span strong table ul "
          "article section main nav header footer aside form").split()
MATH = set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover "
           "mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
# Fixed lists of the weak labels.
OUTSIDE = set("head title nav header footer aside form menu dialog button select fieldset".split())
PARTS = set("nav navbar menu header footer sidebar ad ads advert advertisement banner promo sponsored cookie cookies consent notice popup modal "
            "subscribe newsletter share social related comment comments reply breadcrumb breadcrumbs pagination pager login search widget".split())
INSIDE = {"article", "main"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_TORN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")  # where quotes don't pair up
_TORN_MOST = 8  # searches for the end of such a tag, before every tag ends at the next ">"
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_SVG_END = re.compile(r"(</svg\s*>)|<(?:" + "|".join(ENDING) + r")[\s/>]", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role."""
    out = [name]
    if "=" in attributes:
        for m in _NAMED.finditer(attributes):
            out += ["." + w for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w]
    return tuple(out)


class Path:
    """The open elements around a block, as the marks of each, outermost first;
    what the labeller needs of them is added up once an element."""

    __slots__ = ("inside", "marks", "outside", "up", "vector")

    def __init__(self, up: Path | None = None, marks: tuple[str, ...] = ()):
        self.up, self.marks, self.vector = up, marks, None
        self.inside = up is not None and (up.inside or marks[0] in INSIDE)
        self.outside = up is not None and (up.outside or marks[0] in OUTSIDE or any(w[1:] in PARTS for w in marks[1:]))

    def __iter__(self):
        out, at = [], self
        while at.up is not None:
            out.append(at.marks)
            at = at.up
        return reversed(out)

    def __eq__(self, other):
        return tuple(self) == tuple(other)

    __hash__ = None

    def sums(self) -> np.ndarray:
        """The hashed vectors of all marks, added up."""
        todo, at = [], self
        while at.vector is None and at.up is not None:
            todo.append(at)
            at = at.up
        total = np.zeros(PATH_DIMS, dtype=np.float32) if at.vector is None else at.vector
        for p in reversed(todo):
            total = total.copy()
            for w in p.marks:
                slot, sign = _slot(w)
                total[slot] += sign
            p.vector = total
        return total


def _tokens(page: str):
    """(start, end, tag) of everything between the texts of a page, in one
    forward scan: tag is (closing, name, attributes), or None for what goes
    with all it holds (comments, raw text elements, drawings).

    An unclosed noscript or template is its start tag alone; other raw text elements without an
    end reach to the end of the page. What a search has found (or not) is kept
    until the scan has passed it, so no part of a page is searched again and again."""
    at, last, torn = 0, page.rfind(">"), 0
    ends: dict[str, re.Match | None] = {}
    svg: re.Match | None = None
    svg_from = -1
    while 0 <= (at := page.find("<", at)) < last:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None
            at = end
            continue
        m = _TAG.match(page, at) if torn < _TORN_MOST else None
        if m is None and (m := _TORN_TAG.match(page, at)):
            torn += 1
        if m is None:
            if page[at + 1] in "!?/":
                end = page.find(">", at) + 1
                yield at, end, None
                at = end
            else:
                at += 1
            continue
        name, end = m[2].lower(), m.end()
        if not m[1] and name in _RAW_END:
            if name not in ends or (ends[name] is not None and ends[name].start() < end):
                ends[name] = _RAW_END[name].search(page, end)
            if ends[name] is not None:
                end = ends[name].end()
            elif name not in ("noscript", "template"):
                end = len(page)
            yield at, end, None
        elif not m[1] and name == "svg" and not m[3].endswith("/"):
            if svg_from < 0 or (svg is not None and svg.start() < end):
                svg, svg_from = _SVG_END.search(page, end), end
            if svg is not None and svg[1]:
                end = svg.end()
                yield at, end, None
            else:
                yield at, end, (m[1], name, m[3])
        else:
            yield at, end, (m[1], name, m[3])
        at = end


def blocks(page: str) -> list[tuple[str, Path, int]]:
    """(text, path of open elements, characters inside links) of every leaf block with text."""
    out: list = []
    root = Path()
    stack: list[Path] = []
    places: dict[str, list[int]] = {}  # where in the stack the elements of a name are
    outer: list[int] = []  # and those that are not inline
    here: list[str] = []
    linked, at, path = 0, 0, root

    def close():
        nonlocal linked
        text = " ".join(html.unescape("".join(here)).split())
        if text:
            out.append((text, path, linked))
        here.clear()
        linked = 0

    def say(s: str):
        nonlocal linked, path
        if not here:
            path = stack[-1] if stack else root
        here.append(s)
        if places.get("a"):
            linked += len(s.strip())

    def end_from(i: int):
        while len(stack) > i:
            places[stack.pop().marks[0]].pop()
        while outer and outer[-1] >= i:
            outer.pop()

    for start, end, tag in _tokens(page):
        if start > at:
            say(page[at:start])
        at = end
        if tag is None:
            continue
        closing, name, attributes = tag
        inline = name in INLINE
        if name == "br":
            say(" ")
        if not inline:
            close()
        if closing:
            # an inline end tag closes nothing beyond its block
            if places.get(name) and (not inline or not outer or places[name][-1] > outer[-1]):
                end_from(places[name][-1])
        elif name not in VOID and not attributes.endswith("/"):
            # a block-level element ends an open paragraph; a list item or table part ends its sibling
            if not inline and outer and stack[outer[-1]].marks[0] in SIBLINGS.get(name, set()) | PARAGRAPHS:
                end_from(outer[-1])
            if not inline:
                outer.append(len(stack))
            places.setdefault(name, []).append(len(stack))
            stack.append(Path(stack[-1] if stack else root, _marks(name, attributes)))
    if at < len(page):
        say(page[at:])
    close()
    return out


SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}


def weak_label(path: Path) -> int:
    """1 main text, 0 not, -1 not known."""
    return 0 if path.outside else 1 if path.inside else -1


_SLOTS: dict[str, tuple[int, float]] = {}


def _slot(word: str) -> tuple[int, float]:
    if word not in _SLOTS:
        if len(_SLOTS) > 20_000:
            _SLOTS.clear()
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        _SLOTS[word] = (h % PATH_DIMS, 1.0 if h >> 16 & 1 else -1.0)
    return _SLOTS[word]


def page_vectors(found) -> np.ndarray:
    """One row of INPUTS numbers a block."""
    x = np.zeros((len(found), INPUTS), dtype=np.float32)
    if not len(found):
        return x
    for i, (text, path, linked) in enumerate(found):
        x[i, :PATH_DIMS] = path.sums()
        n = len(text)
        x[i, -MEASURES:] = (np.log1p(n) / 8, linked / max(n, linked, 1), i / len(found), text[-1] in ".!?:;…")
    raw = [t.encode("utf-8", "surrogatepass") for t, _, _ in found]
    data = np.frombuffer(b"".join(r + b"\n" for r in raw), dtype=np.uint8)
    s, e = word_bounds(data)
    h = span_hashes(data, s, e)
    row = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), s, side="right")
    key = row * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64)
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    bag = np.bincount(key, sign, minlength=len(found) * WORD_DIMS).reshape(len(found), WORD_DIMS)
    x[:, PATH_DIMS: PATH_DIMS + WORD_DIMS] = bag / (np.linalg.norm(bag, axis=1, keepdims=True) + 1e-6)
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BiLstm:
    """Two LSTM passes over a padded batch [page, block, inputs], one logit a block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, (INPUTS + HIDDEN) ** -0.5, (INPUTS + HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.zeros(4 * HIDDEN)
            self.p["c" + d][HIDDEN: 2 * HIDDEN] = 1.0  # gates begin by remembering
        self.p["o"], self.p["q"] = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)

    def _pass(self, x, mask, d, record=None):
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.zeros((n, steps, HIDDEN))
        w, bias = self.p["w" + d], self.p["c" + d]
        given = x @ w[:INPUTS] + bias
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ w[INPUTS:]
            i, f, o = (_sigmoid(z[:, k * HIDDEN: (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t: t + 1]
            nc = f * c + i * g
            th = np.tanh(nc)
            if record is not None:
                record.append((t, h, c, i, f, o, g, th, m))
            c = m * nc + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[:, t] = h
        return out

    def logits(self, x, mask):
        both = np.concatenate([self._pass(x, mask, "f"), self._pass(x, mask, "b")], axis=2)
        return both @ self.p["o"] + self.p["q"]

    def gradients(self, x, mask, y, known):
        """Of the mean cross-entropy over the blocks with known labels."""
        tape = {"f": [], "b": []}
        both = np.concatenate([self._pass(x, mask, d, tape[d]) for d in "fb"], axis=2)
        err = (_sigmoid(both @ self.p["o"] + self.p["q"]) - y) * known / max(known.sum(), 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["q"] = np.einsum("nt,nth->h", err, both), err.sum(keepdims=True).reshape(1)
        for j, d in enumerate("fb"):
            top = err[:, :, None] * self.p["o"][j * HIDDEN: (j + 1) * HIDDEN]
            dh, dc, w = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN)), self.p["w" + d]
            for t, h, c, i, f, o, cand, th, m in reversed(tape[d]):
                full = dh + top[:, t]
                a, s = m * full, m * dc
                s = s + a * o * (1 - th * th)
                dz = np.concatenate([s * cand * i * (1 - i), s * c * f * (1 - f), a * th * o * (1 - o), s * i * (1 - cand * cand)], axis=1)
                g["w" + d] += np.concatenate([x[:, t], h], axis=1).T @ dz
                g["c" + d] += dz.sum(axis=0)
                dh = dz @ w[INPUTS:].T + (1 - m) * full
                dc = s * f + (1 - m) * dc
        return g

    def fit(self, pages, epochs: int = 14, batch: int = 24, rate: float = 0.01):
        """pages: (vectors, labels with -1 for not known)."""
        rng = np.random.default_rng(9)
        m, v, t = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2)), None, 0
        m, v = list(m)
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // batch)):
                x, mask = padded([pages[r][0] for r in rows])
                y = np.full(mask.shape, -1.0)
                for k, r in enumerate(rows):
                    y[k, : len(pages[r][1])] = pages[r][1]
                # now and then the names of elements are hidden, so that words and neighbours count too
                x[:, :, :PATH_DIMS] *= rng.random((len(x), x.shape[1], 1)) > 0.1
                g = self.gradients(x, mask, np.maximum(y, 0), (y >= 0).astype(float))
                norm = np.sqrt(sum((q * q).sum() for q in g.values()))
                t += 1
                step = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs)) + 1e-4
                for k in self.p:
                    q = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                    self.p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def padded(vectors) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in vectors)
    out, mask = np.zeros((len(vectors), steps, INPUTS)), np.zeros((len(vectors), steps))
    for i, x in enumerate(vectors):
        out[i, : len(x)], mask[i, : len(x)] = x, 1
    return out, mask


def label(model: BiLstm | None, vectors: list[np.ndarray]) -> list[np.ndarray]:
    """Whether each block of each page is main text; pages of like length run together."""
    out: list = [np.zeros(0, dtype=bool)] * len(vectors)
    order = sorted((i for i in range(len(vectors)) if len(vectors[i])), key=lambda i: len(vectors[i]))
    while order:
        group = [order.pop()]  # the longest left, and as many shorter ones as fit
        steps = len(vectors[group[0]])
        while order and (len(group) + 1) * steps <= CELLS and len(vectors[order[-1]]) * 2 >= steps:
            group.append(order.pop())
        x, mask = padded([vectors[i] for i in group])
        z = model.logits(x, mask)
        for k, i in enumerate(group):
            out[i] = z[k, : len(vectors[i])] > 0
    return out


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> BiLstm | None:
    """A labeller learnt from the weak labels of a bounded number of pages."""
    ship(pages.sparkSession)
    some = (pages.select(F.xxhash64("page_id").alias("__h"), F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
            .where("html is not null"))
    some = some.join(F.broadcast(some.select("__h", "page_id").orderBy("__h", "page_id").limit(train_pages)), ["__h", "page_id"], "left_semi").select("html")

    def run(batches):
        for b in slices(batches, 64):
            xs, ys, ns = [], [], []
            for t in b.column(0).to_pylist():
                found = blocks(t)[: 4 * TRAIN_BLOCKS]
                if found:
                    xs.append(page_vectors(found).astype(np.float32).tobytes())
                    ys.append(bytes(weak_label(p) + 1 for _, p, _ in found))
                    ns.append(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    got = some.mapInArrow(run, "x binary, y binary").orderBy("y", "x").limit(train_pages).collect()
    taught = []
    for r in got:
        x, y = np.frombuffer(bytes(r.x), dtype=np.float32).reshape(-1, INPUTS), np.frombuffer(bytes(r.y), dtype=np.uint8).astype(int) - 1
        taught += [(x[i: i + TRAIN_BLOCKS], y[i: i + TRAIN_BLOCKS]) for i in range(0, len(y), TRAIN_BLOCKS)]
    if len({v for _, y in taught for v in y.tolist() if v >= 0}) < 2:
        return None
    return BiLstm().fit(taught, epochs=max(14, 3000 // len(taught)) if len(taught) < 400 else 14)


def extract(pages: DataFrame, model: BiLstm | None = None) -> DataFrame:
    """``pages`` without html, with text (main text), n_blocks and n_main_blocks."""
    model = model or train(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    others = [c for c in pages.columns if c not in ("html", "text", "n_blocks", "n_main_blocks")]
    names = [*others, "text", "n_blocks", "n_main_blocks"]

    def run(batches):
        for b in slices(batches, 128):
            found = [blocks(t) if t else [] for t in b.column(0).to_pylist()]
            if shared.value is None:
                chosen = [[all(e[0] != "head" for e in p) for _, p, _ in page] for page in found]
            else:
                chosen = label(shared.value, [page_vectors(page) for page in found])
            text = ["\n\n".join(x[0] for x, take in zip(page, takes, strict=True) if take) for page, takes in zip(found, chosen, strict=True)]
            made = [pa.array(text, pa.string()), pa.array([len(p) for p in found], pa.int64()), pa.array([int(sum(c)) for c in chosen], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), *made], names=names)

    kept = [F.col(f"`{c}`") for c in others]
    schema = pages.select(*kept, F.lit("").cast("string").alias("text"), F.lit(0).cast("long").alias("n_blocks"), F.lit(0).cast("long").alias("n_main_blocks")).schema
    return pages.select(F.col("html").cast("string").alias("__html"), *kept).mapInArrow(run, schema)
