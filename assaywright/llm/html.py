"""Main text of web pages by a recurrent block labeller: op8.

A page becomes a sequence of leaf blocks, each with the names on its tag path, its words (both hashed) and a few measures. A
bidirectional LSTM in numpy reads the whole sequence and decides on every block in its context. It is trained from a fixed seed
on invented pages (_pages.py) with known main text, by `python -m assaywright.llm.html`, which writes the weights to
labeller.npz beside this file together with what they were made from; where that file is missing or made from something else,
the driver trains anew. The weights (under 1 MB) are broadcast.

Text in one block is joined over inline tags; blocks begin and end at block-level tags. Markup, comments, head, scripts and styles are never
blocks. Character references are decoded, white space in a block becomes one space, and kept blocks are joined by one space. Time is
in proportion to a page's length, however its tags are nested or broken.
"""

from __future__ import annotations

import bisect
import contextlib
import ctypes
import functools
import hashlib
import html as entities
import io
import pkgutil
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ready, released, table
from ._pages import Maker

PATH_BUCKETS, WORD_BUCKETS, MEASURES, VECTOR, HIDDEN = 1024, 2048, 8, 32, 24
#: Blocks of one page that are described at once.
LONG = 8192
#: Elements that break blocks, that never hold text, that close by themselves, and whose content is dropped.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul button label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video noembed noframes xmp".split())
#: An opening tag ends an open element of these within the given limits.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: What may stand in head; any other start tag ends it, unless a title is open.
IN_HEAD = frozenset("html head title base basefont bgsound link meta script style noscript template noframes".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag: a quote hides what it holds only after an equals sign.
_REST = re.compile(r"""(?>[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_TELLING = frozenset("class id role itemprop aria-label".split())
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_LANDMARK = frozenset("article main nav aside header footer form section dialog".split())
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: Of those whose content is dropped, the ones that run to the end of the page if they are never closed.
_ENDLESS = frozenset("script style xmp noembed noframes".split())


@dataclass
class Block:
    text: str
    path: np.ndarray  # ascending buckets of the names of all open elements
    linked: int  # characters inside links
    mark: bool = False


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_BUCKETS


def _names(tag: str, attrs: str) -> tuple[int, ...]:
    """The buckets of what an element adds to a path: its name and the parts of its class, id and role."""
    out = [_bucket("t:" + tag)]
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name == "hidden":
            out.append(_bucket("hidden"))
        elif name in _TELLING:
            out += [_bucket("n:" + x.lower()) for x in _NAME.findall(value)]
    return tuple(dict.fromkeys(out))


_names_again = functools.lru_cache(maxsize=20_000)(_names)


class _Open:
    """The open elements of a page: their order, where each name stands, and the buckets of the path."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[int, ...], int, str]] = []  # name, buckets, nearest block element, nearest landmark
        self.where: dict[str, list[int]] = {}
        self.live: dict[int, int] = {}
        self._path: np.ndarray | None = None

    def has(self, tag: str) -> bool:
        return bool(self.where.get(tag))

    def last(self, tags: frozenset[str] | set[str]) -> int:
        """The place of the innermost open element of these, -1 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def push(self, tag: str, buckets: tuple[int, ...]) -> None:
        k = len(self.stack)
        near, mark = (self.stack[-1][2], self.stack[-1][3]) if k else (-1, "")
        self.stack.append((tag, buckets, k if tag in BLOCK else near, tag if tag in _LANDMARK else mark))
        self.where.setdefault(tag, []).append(k)
        for b in buckets:
            self.live[b] = self.live.get(b, 0) + 1
        self._path = None

    def cut(self, k: int) -> None:
        """Close the element at place k and all inside it."""
        while len(self.stack) > k:
            tag, buckets, _, _ = self.stack.pop()
            self.where[tag].pop()
            for b in buckets:
                self.live[b] -= 1
                if not self.live[b]:
                    del self.live[b]
        self._path = None

    def near(self) -> int:
        return self.stack[-1][2] if self.stack else -1

    def path(self) -> np.ndarray:
        if self._path is None:
            own = self.stack[self.near()][0] if self.near() >= 0 else ""
            mark = self.stack[-1][3] if self.stack else ""
            self._path = np.array(sorted({*self.live, _bucket("l:" + own), _bucket("i:" + mark)}), np.int64)
        return self._path


def blocks(page: str, marks: bool = False) -> list[Block]:
    """The page's leaf blocks in order. marks: \\x01 and \\x02 begin and end what is to be marked (for training)."""
    open_ = _Open()
    out: list[Block] = []
    held: list[str] = []
    linked, inside = 0, False

    def flush() -> None:
        nonlocal held, linked
        if held and not open_.has("head") and not open_.has("title"):
            text = "".join(held)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block(text, open_.path(), linked, inside))
        held, linked = [], 0

    def text_of(s: str) -> None:
        nonlocal linked, inside
        if marks and ("\x01" in s or "\x02" in s):
            for piece in re.split("([\x01\x02])", s):
                if piece in ("\x01", "\x02") and piece:
                    flush()
                    inside = piece == "\x01"
                elif piece:
                    held.append(piece)
            return
        held.append(s)
        if open_.has("a"):
            linked += len(s)

    at, n, last = 0, len(page), page.rfind(">")
    hiding = True  # whether quotes may hide the end of a tag; not any more once they have hidden it up to the end of the page
    unclosed: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt > at:
            text_of(page[at:lt])
        if lt < 0:
            text_of(page[at:])
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = end + 3 if end >= 0 else n
            continue
        m = _NAMED.match(page, lt) if lt < last else None
        if m is None:
            if lt < last and page.startswith(("<!", "<?"), lt):
                at = page.find(">", lt) + 1
            elif lt < last:
                text_of("<")
                at = lt + 1
            else:
                text_of(page[lt:])
                break
            continue
        rest = _REST.match(page, m.end()) if hiding else None
        if rest is None:
            hiding = False
            at = page.find(">", m.end()) + 1
            if not at:
                text_of(page[lt:])
                break
        else:
            at = rest.end()
        close, tag, attrs = m[1], m[2].lower(), page[m.end() : at - 1]
        if close:
            if tag in BLOCK:
                flush()
            if open_.has(tag):
                open_.cut(open_.where[tag][-1])
            continue
        if tag not in IN_HEAD and open_.has("head") and not open_.has("title"):
            flush()
            open_.cut(open_.where["head"][0])
        if tag in RAW and not attrs.endswith("/"):
            end = None if tag in unclosed else _ENDS[tag].search(page, at)
            if end is not None:
                at = page.find(">", end.end()) + 1 or n
                continue
            unclosed.add(tag)
            if tag in _ENDLESS:
                break
        if tag == "br":
            held.append(" ")
        if tag in BLOCK:
            flush()
            if tag not in ("button", "label", "option", "optgroup", "select"):  # these may stand in a paragraph
                k = open_.near()
                if k >= 0 and open_.stack[k][0] == "p":
                    open_.cut(k)
        if tag in CLOSES:
            ends, limit = CLOSES[tag]
            low = open_.last(limit)
            k = open_.last(ends)
            if k > low:
                if tag == "tr":  # a cell and its row
                    k = min(w[i] for t in ends if (i := bisect.bisect_right(w := open_.where.get(t, []), low)) < len(w))
                open_.cut(k)
        if tag in VOID:
            continue
        telling = tag in BLOCK or tag in ("a", "span") or attrs
        open_.push(tag, (_names if len(attrs) > 300 else _names_again)(tag, attrs if telling else ""))
    flush()
    return out


def _word_bucket(word: str) -> int:
    return PATH_BUCKETS + zlib.crc32(word.encode("utf-8", "replace")) % WORD_BUCKETS


_word_again = functools.lru_cache(maxsize=100_000)(_word_bucket)


def describe(page: list[Block], first: int = 0, total: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, where each block's begin, measures) of a page's blocks, or of those from `first` on of `total`."""
    buckets, weights, begin, measures = [], [], [], []
    at, total = 0, total or len(page)
    for i, b in enumerate(page, first):
        p = b.path
        low = b.text.lower().split()
        words = set(low)
        w = np.array(sorted({_word_again(x) if len(x) < 40 else _word_bucket(x) for x in words}), np.int64)
        buckets += [p, w]
        weights += [np.ones(len(p), np.float32), np.full(len(w), 1 / max(4.0, len(w)), np.float32)]
        begin.append(at)
        at += len(p) + len(w)
        n = len(b.text)
        last = b.text[-1]
        measures.append((min(np.log1p(n) / 6, 2), min(len(low) / 50, 2), min(1.0, b.linked / n), last in ".!?", b.text.count(",") / max(1, len(low)), i / total, 1 / (1 + i), 1.0))
    return np.concatenate(buckets), np.concatenate(weights), np.array(begin), np.array(measures, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(z: np.ndarray, u: np.ndarray, keep: bool = False, state: tuple[np.ndarray, np.ndarray] | None = None):
    """LSTM over z (time, pages, 4 * HIDDEN) from a state (zeros if none): hidden states, what the way back needs, the last state."""
    t, b, _ = z.shape
    h, c = state or (np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32))
    hs = np.zeros((t, b, HIDDEN), np.float32)
    saved = []
    for k in range(t):
        a = z[k] + h @ u
        s = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[k] = h
        if keep:
            saved.append((*before, i, f, o, g, tc))
    return hs, saved, (h, c)


def _back(dh: np.ndarray, u: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray]:
    t, b, _ = dh.shape
    dz, du = np.zeros((t, b, 4 * HIDDEN), np.float32), np.zeros_like(u)
    nh, nc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        h0, c0, i, f, o, g, tc = saved[k]
        d = dh[k] + nh
        dc = nc + d * o * (1 - tc * tc)
        dz[k] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        nc = dc * f
        nh = dz[k] @ u.T
        du += h0.T @ dz[k]
    return dz, du


def _order(sizes: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of blocks in (time, pages), forwards and with each page reversed."""
    page = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return step * len(sizes) + page, (sizes[page] - 1 - step) * len(sizes) + page


class Labeller:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        s = lambda *shape: (r.normal(size=shape) * 0.1).astype(np.float32)
        self.w = {"e": 3 * s(PATH_BUCKETS + WORD_BUCKETS, VECTOR), "p": 2 * s(VECTOR, 8 * HIDDEN), "m": s(MEASURES, 8 * HIDDEN), "uf": s(HIDDEN, 4 * HIDDEN), "ub": s(HIDDEN, 4 * HIDDEN), "o": s(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}

    def _inputs(self, described: list) -> tuple:
        buckets, weights = np.concatenate([d[0] for d in described]), np.concatenate([d[1] for d in described])
        shift = np.cumsum([0, *[len(d[0]) for d in described]])
        begin = np.concatenate([d[2] + s for d, s in zip(described, shift, strict=False)])
        measures = np.concatenate([d[3] for d in described])
        sizes = np.array([len(d[2]) for d in described])
        vectors = np.add.reduceat(self.w["e"][buckets] * weights[:, None], begin, axis=0)
        return buckets, weights, begin, measures, sizes, vectors, vectors @ self.w["p"] + measures @ self.w["m"]

    def forward(self, described: list, keep: bool = False):
        buckets, weights, begin, measures, sizes, vectors, x = self._inputs(described)
        t = int(sizes.max())
        fwd, rev = _order(sizes, t)
        parts = []
        for half, at, u in ((slice(0, 4 * HIDDEN), fwd, "uf"), (slice(4 * HIDDEN, None), rev, "ub")):
            z = np.zeros((t * len(sizes), 4 * HIDDEN), np.float32)
            z[at] = x[:, half]
            hs, saved, _ = _run(z.reshape(t, len(sizes), -1), self.w[u], keep)
            parts.append((hs.reshape(-1, HIDDEN)[at], saved, at))
        both = np.concatenate([parts[0][0], parts[1][0]], axis=1)
        score = both @ self.w["o"][:, 0] + self.w["c"]
        return score, (buckets, weights, begin, measures, sizes, vectors, both, parts, t)

    def gradients(self, described: list, truth: np.ndarray) -> tuple[float, dict]:
        score, (buckets, weights, begin, measures, sizes, vectors, both, parts, t) = self.forward(described, keep=True)
        p = _sigmoid(score)
        d = ((p - truth) / len(truth)).astype(np.float32)
        grads = {"o": both.T @ d[:, None], "c": d.sum(keepdims=True)}
        dboth = d[:, None] * self.w["o"][:, 0]
        dx = np.zeros((len(truth), 8 * HIDDEN), np.float32)
        for k, name in enumerate(("uf", "ub")):
            dh = np.zeros((t * len(sizes), HIDDEN), np.float32)
            at = parts[k][2]
            dh[at] = dboth[:, k * HIDDEN : (k + 1) * HIDDEN]
            dz, grads[name] = _back(dh.reshape(t, len(sizes), HIDDEN), self.w[name], parts[k][1])
            dx[:, k * 4 * HIDDEN : (k + 1) * 4 * HIDDEN] = dz.reshape(-1, 4 * HIDDEN)[at]
        grads["m"] = measures.T @ dx
        grads["p"] = vectors.T @ dx
        dv = dx @ self.w["p"].T
        owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(buckets))))
        by = np.argsort(buckets, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(buckets[by]) > 0))
        e = np.zeros_like(self.w["e"])
        e[buckets[by][first]] = np.add.reduceat((dv[owner] * weights[:, None])[by], first, axis=0)
        grads["e"] = e
        loss = float(-np.mean(truth * np.log(p + 1e-7) + (1 - truth) * np.log(1 - p + 1e-7)))
        return loss, grads

    def train(self, pages: list[list[Block]], epochs: int, batch: int = 64, rate: float = 0.015) -> None:
        pages = [p for p in pages if p]
        data = [(describe(p), np.array([b.mark for b in p], np.float32)) for p in pages]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        r, n = np.random.default_rng(1), 0
        steps = epochs * -(-len(data) // batch)
        for _ in range(epochs):
            order = r.permutation(len(data))
            for group in (order[i : i + batch * 8] for i in range(0, len(order), batch * 8)):  # pages of like length together
                group = group[np.argsort([len(data[i][1]) for i in group], kind="stable")]
                for i in range(0, len(group), batch):
                    some = [data[k] for k in group[i : i + batch]]
                    _, grads = self.gradients([d for d, _ in some], np.concatenate([y for _, y in some]))
                    n += 1
                    now = rate * (1 - n / (steps + 1))
                    size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                    for k, g in grads.items():
                        g = g * min(1.0, 5.0 / (size + 1e-9))
                        first[k] += 0.1 * (g - first[k])
                        second[k] += 0.001 * (g * g - second[k])
                        self.w[k] -= now * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)

    def score_long(self, page: list[Block]) -> np.ndarray:
        """The scores of one page, read in stretches of LONG blocks whose states are handed on, so that only scores are kept."""
        n = len(page)
        out = np.full(n, self.w["c"][0], np.float32)
        for u, back in (("uf", False), ("ub", True)):
            half, part = (slice(4 * HIDDEN, None), slice(HIDDEN, None)) if back else (slice(0, 4 * HIDDEN), slice(0, HIDDEN))
            state = None
            for lo in sorted(range(0, n, LONG), reverse=back):
                some = page[lo : lo + LONG]
                x = self._inputs([describe(some, lo, n)])[-1][:, half]
                hs, _, state = _run(np.ascontiguousarray(x[::-1] if back else x)[:, None, :], self.w[u], state=state)
                got = hs[:, 0] @ self.w["o"][part, 0]
                out[lo : lo + LONG] += got[::-1] if back else got
        return out

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which blocks are main text. Pages of like length are run together, very long ones alone."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 128 and (j - i + 1) * len(pages[order[j]]) <= 20_000:
                j += 1
            some = order[i:j]
            if len(some) == 1:
                out[some[0]] = self.score_long(pages[some[0]]) > 0
                i = j
                continue
            score, _ = self.forward([describe(pages[k]) for k in some])
            cut = np.cumsum([0, *[len(pages[k]) for k in some]])
            for k, s, e in zip(some, cut, cut[1:], strict=False):
                out[k] = score[s:e] > 0
            i = j
        return out


@contextlib.contextmanager
def _one_thread() -> Iterator[None]:
    """Small matrix products are slower on many threads than on one; the driver's numpy uses all cores otherwise."""
    calls = []
    for path in (Path(np.__file__).resolve().parents[1] / "numpy.libs").glob("*openblas*"):
        lib = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            get, put = (getattr(lib, name.format(x), None) for x in ("get", "set"))
            if get and put:
                calls.append((put, int(get())))
                break
    for put, _ in calls:
        put(1)
    try:
        yield
    finally:
        for put, n in calls:
            put(n)


TRAIN_PAGES, EPOCHS, SEED = 40_000, 8, 11
WEIGHTS = Path(__file__).with_name("labeller.npz")


def fit(pages: int, epochs: int, seed: int) -> Labeller:
    maker = Maker(seed)
    model = Labeller()
    with _one_thread():
        model.train([blocks(maker.page(), marks=True) for _ in range(pages)], epochs)
    return model


def recipe() -> str:
    """What the weights hang on: the numbers above and a digest of the page maker and of this module's reading of pages."""
    made = hashlib.sha256(pkgutil.get_data(__package__, "_pages.py") or b"")
    made.update("".join(f"{b.text}|{b.path.tolist()}|{b.linked}" for b in blocks(Maker(SEED).page())).encode())
    return f"{TRAIN_PAGES} pages, {EPOCHS} epochs, seed {SEED}, {made.hexdigest()}"


@functools.lru_cache(maxsize=1)
def trained() -> Labeller:
    """The labeller with the stored weights, or trained anew if there are none of this recipe."""
    model = Labeller()
    try:
        stored = pkgutil.get_data(__package__, WEIGHTS.name)  # from a folder or a zip
    except FileNotFoundError:
        stored = None
    if stored:
        with np.load(io.BytesIO(stored), allow_pickle=False) as f:
            if str(f["recipe"]) == recipe():
                model.w = {k: f[k].astype(np.float32) for k in model.w}
                return model
    return fit(TRAIN_PAGES, EPOCHS, SEED)


def store_weights() -> None:
    """Train and write the weights, in half precision (which the held-out tests read too)."""
    w = fit(TRAIN_PAGES, EPOCHS, SEED).w
    np.savez_compressed(WEIGHTS, recipe=recipe(), **{k: v.astype(np.float16) for k, v in w.items()})


def extract(df: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Adds the main text and its number of code points, n_chars. A null or empty page, or one without main text, has "" and 0.
    Repeated rows have equal texts; pages of any length and depth are read whole. An empty table gives no rows. Columns of these
    names are replaced, unless one of them is the page itself, which is read first."""
    spark = df.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(trained().w)
    if html in (name, "n_chars"):
        return extract(df.withColumnRenamed(html, "_html"), "_html", name).drop("_html")
    df = df.drop(name, "n_chars")
    schema = df.select("*", F.lit(None).cast("string").alias(name), F.lit(None).cast("bigint").alias("n_chars")).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller()
        model.w = shared.value
        for batch in it:
            pages = [blocks(x.as_py() or "") for x in batch.column(batch.schema.get_field_index(html))]
            texts = [" ".join(b.text for b, k in zip(p, keep, strict=True) if k) for p, keep in zip(pages, model.label(pages), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, name, "n_chars"])

    return df.mapInArrow(released(run), schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")


if __name__ == "__main__":
    from assaywright.llm import html as module  # not the copy that runs as __main__

    module.store_weights()
