"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of text blocks.  Each block is read as a vector of its tag path (tags, class
and id words), of its hashed words and of a few sizes; a bidirectional LSTM in numpy reads the
sequence and labels every block with the whole page as context.  It learns from a bounded sample of pages whose
own article element tells the answer, mixed with other usual page parts at random places.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import table
from gaugeline.llm.language import sample
from gaugeline.llm.subword import words_of

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|[!?/][^>]*>)", re.S)
MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")
SILENT = frozenset("script style noscript template textarea title select svg iframe object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figure footer form h1 h2 h3 h4 h5 "
                     "h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"},
            "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


@dataclass
class Block:
    """A text with the elements it stands in, each as a tuple of words (tag first), and its characters inside links."""

    text: str
    path: tuple[tuple[str, ...], ...]
    linked: int


def blocks(page: str) -> list[Block]:
    """The texts between block-level tags, white space turned into single spaces, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    state = {"path": (), "linked": 0}

    def text(raw: str) -> None:
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            if not raw.isspace():
                if not any(x and not x.isspace() for x in held):
                    state["path"], state["linked"] = tuple(words for _, words in stack), 0
                if any(tag == "a" for tag, _ in stack):
                    state["linked"] += len(raw)
            held.append(raw)

    def end_block() -> None:
        if held:
            joined = " ".join("".join(held).split())
            if joined:
                out.append(Block(joined, state["path"], min(state["linked"], len(joined))))
            held.clear()

    def pop_to(depth: int) -> None:
        del stack[depth:]

    at = 0
    find = TAG.search
    while True:
        m = find(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                end_block()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in SILENT and not m[3].endswith("/"):
            if name not in INLINE:
                end_block()
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name not in INLINE:
            end_block()
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if name in SIBLINGS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if stack[depth][0] in SIBLINGS[name]:
                    break
        if name not in VOID and not m[3].endswith("/"):
            marks = [w.lower() for k in MARK.findall(m[3]) for w in PART.findall("".join(k[1:]))] if "=" in m[3] else []
            stack.append((name, (name, *["." + w for w in marks])))
    end_block()
    return out


# Words in tags, classes and ids that mark parts of a page.
BODY_PARTS = ("article", "main", ".article", ".main", ".content", ".post", ".entry", ".story", ".body", ".text")
OTHER_PARTS = ("nav", "header", "footer", "aside", "form", "button", "dialog", "menu", ".nav", ".navbar", ".menu", ".header", ".masthead",
               ".footer", ".sidebar", ".aside", ".widget", ".ad", ".ads", ".advert", ".advertisement", ".sponsored",
               ".banner", ".promo", ".cookie", ".cookies", ".consent", ".notice", ".alert", ".popup", ".modal",
               ".subscribe", ".newsletter", ".signup", ".login", ".search", ".share", ".social", ".related",
               ".recommended", ".breadcrumb", ".breadcrumbs", ".pagination", ".comment", ".comments", ".respond",
               ".reply", ".disqus", ".copyright", ".toolbar", ".skip", ".tags", ".meta")
NOT_BODY, BODY = frozenset(OTHER_PARTS), frozenset(BODY_PARTS)


def told(path: tuple[tuple[str, ...], ...]) -> int:
    """What a page itself says: 1 in an article or main part, 0 in another part or in neither."""
    words = {w for element in path for w in element}
    return int(bool(words & BODY) and not words & NOT_BODY)


PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, SIZES, HIDDEN = 1024, 1024, 12, 4, 5, 12
INPUT = PATH_DIM + WORD_DIM + SIZES
LEARN_PAGES = 400
PLAIN_PAGES = 80
LEARN_BLOCKS = 120


@dataclass
class Coded:
    """Blocks of one page as hashed features; `path` and `word` are flat with the block each belongs to."""

    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    sizes: np.ndarray


def code(pages: list[list[Block]]) -> list[Coded]:
    """The features of each page, from all words of its blocks."""
    texts = [b.text for found in pages for b in found]
    words = words_of(pa.array(texts, pa.string()), lower=True)
    buckets = np.array([crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words.unique.to_pylist()], np.int64)
    per_word, cache, out, done = buckets[words.codes], {}, [], 0
    for found in pages:
        n = len(found)
        path, path_of, sizes = [], [], np.zeros((n, SIZES), np.float32)
        for k, b in enumerate(found):
            if b.path not in cache:
                cache[b.path] = sorted({crc32(w.encode()) % PATH_BUCKETS for element in b.path for w in element})
            path += cache[b.path]
            path_of += [k] * len(cache[b.path])
            sizes[k] = (np.log1p(len(b.text)) / 5, b.linked / len(b.text), b.text[-1] in ".!?…", k / n, len(b.path) / 10)
        bounds = words.bounds[done:done + n + 1]
        done += n
        out.append(Coded(np.array(path, np.int64), np.array(path_of, np.int64), per_word[bounds[0]:bounds[-1]],
                         np.repeat(np.arange(n), np.diff(bounds)), sizes))
    return out


class Labeller:
    """Embeddings, one LSTM per direction, and a logistic output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)

        def w(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"path": 0.3 * r.standard_normal((PATH_BUCKETS, PATH_DIM)).astype(np.float32),
                  "word": 0.1 * r.standard_normal((WORD_BUCKETS, WORD_DIM)).astype(np.float32),
                  "out": w(2 * HIDDEN + PATH_DIM, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p[f"x{side}"], self.p[f"h{side}"] = w(INPUT, 4 * HIDDEN), w(HIDDEN, 4 * HIDDEN)
            self.p[f"c{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)

    def inputs(self, pages: list[Coded]) -> tuple[np.ndarray, np.ndarray]:
        """(page, block, feature), padded, and which are real."""
        longest = max(len(c.sizes) for c in pages)
        x, real = np.zeros((len(pages), longest, INPUT), np.float32), np.zeros((len(pages), longest), bool)
        for k, c in enumerate(pages):
            n = len(c.sizes)
            real[k, :n] = True
            for at, dim, ids, of, what, power in ((0, PATH_DIM, c.path, c.path_of, "path", 0.5),
                                                  (PATH_DIM, WORD_DIM, c.word, c.word_of, "word", 1.0)):
                count = np.maximum(np.bincount(of, minlength=n), 1) ** power
                for d in range(dim):
                    x[k, :n, at + d] = np.bincount(of, self.p[what][ids, d], n) / count
            x[k, :n, -SIZES:] = c.sizes
        return x, real

    def _lstm(self, x: np.ndarray, real: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states; padding leaves the state as it is.  keep: gets what the way back needs."""
        b, t, _ = x.shape
        h, c, out = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32), np.zeros((b, t, HIDDEN), np.float32)
        wx = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = wx[:, k] + h @ self.p[f"h{side}"]
            gate = 1 / (1 + np.exp(-np.clip(z[:, :3 * HIDDEN], -30, 30)))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            m = real[:, k, None]
            if keep is not None:
                keep.append((k, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[:, k] = h
        return out

    def logits(self, x: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = [self._lstm(x, real, side, keep.setdefault(side, []) if keep is not None else None) for side in "fb"]
        top = np.concatenate([*both, x[:, :, :PATH_DIM]], 2)
        if keep is not None:
            keep["top"] = top
        return (top @ self.p["out"])[:, :, 0] + self.p["bias"]

    def gradients(self, pages: list[Coded], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over blocks, through time in both directions."""
        x, real = self.inputs(pages)
        keep: dict = {}
        z = self.logits(x, real, keep)
        y = np.zeros(real.shape, np.float32)
        for k, own in enumerate(labels):
            y[k, :len(own)] = own
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * real / real.sum()).astype(np.float32)
        grad = {"out": (keep["top"] * dz[:, :, None]).sum((0, 1))[:, None], "bias": np.array([dz.sum()])}
        d_top = dz[:, :, None] * self.p["out"][:, 0]
        dx = np.zeros_like(x)
        dx[:, :, :PATH_DIM] += d_top[:, :, 2 * HIDDEN:]
        for s, side in enumerate("fb"):
            d_out = d_top[:, :, s * HIDDEN:(s + 1) * HIDDEN]
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            d_z = np.zeros((*real.shape, 4 * HIDDEN), np.float32)
            d_wh = np.zeros_like(self.p[f"h{side}"])
            for k, h0, c0, i, f, o, g, tc, m in reversed(keep[side]):
                dh = dh + d_out[:, k]
                dh_in, dc_in = dh * m, dc * m
                dc_new = dc_in + dh_in * o * (1 - tc**2)
                step = np.concatenate([dc_new * g * i * (1 - i), dc_new * c0 * f * (1 - f), dh_in * tc * o * (1 - o),
                                       dc_new * i * (1 - g**2)], 1)
                d_z[:, k] = step
                d_wh += h0.T @ step
                dh = np.where(m, step @ self.p[f"h{side}"].T, dh)
                dc = np.where(m, dc_new * f, dc)
            flat = d_z.reshape(-1, 4 * HIDDEN)
            grad[f"h{side}"], grad[f"c{side}"] = d_wh, flat.sum(0)
            grad[f"x{side}"] = x.reshape(-1, INPUT).T @ flat
            dx += d_z @ self.p[f"x{side}"].T
        for at, dim, what, power in ((0, PATH_DIM, "path", 0.5), (PATH_DIM, WORD_DIM, "word", 1.0)):
            g = np.zeros_like(self.p[what])
            for k, c in enumerate(pages):
                ids, of = (c.path, c.path_of) if what == "path" else (c.word, c.word_of)
                scale = 1 / np.maximum(np.bincount(of, minlength=len(c.sizes)), 1) ** power
                np.add.at(g, ids, dx[k, of, at:at + dim] * scale[of, None])
            grad[what] = g
        return grad

    def fit(self, pages: list[Coded], labels: list[np.ndarray], rounds: int = 12, rate: float = 0.01, size: int = 32) -> None:
        """Stochastic gradient descent with Adam's step sizes."""
        r = np.random.default_rng(5)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(rounds):
            order = r.permutation(len(pages))
            for a in range(0, len(order), size):
                own = order[a:a + size]
                t += 1
                for k, g in self.gradients([pages[i] for i in own], [labels[i] for i in own]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def main(self, pages: list[list[Block]], size: int = 128) -> list[list[bool]]:
        """Which blocks are main text, pages of like length together."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        for a in range(0, len(order), size):
            own = order[a:a + size]
            x, real = self.inputs(code([pages[k] for k in own]))
            z = self.logits(x, real)
            for row, k in enumerate(own):
                out[k] = (z[row, :len(pages[k])] > 0).tolist()
        return out


def _parts(r: np.random.Generator, text: str) -> list[Block]:
    """A part that is not main text: one to five blocks of the given text's words."""
    mark = OTHER_PARTS[r.integers(len(OTHER_PARTS))]
    outer = (mark,) if mark[0] != "." else (("div", "section", "ul", "p")[r.integers(4)], mark)
    inner = ((), (("p",),), (("ul",), ("li",)), (("div",),), (("li",), ("a",)), (("h2",),), (("span",),))[r.integers(7)]
    words = text.split()
    out = []
    for _ in range(r.integers(1, 6)):
        size = int(r.integers(1, 40))
        at = int(r.integers(max(1, len(words) - size)))
        own = " ".join(words[at:at + size]) or "x"
        out.append(Block(own, (outer, *inner), len(own) if ("a",) in inner else 0))
    return out


def lesson(r: np.random.Generator, found: list[Block]) -> tuple[list[Block], np.ndarray]:
    """A page to learn from: its blocks and labels, with parts put in anywhere, also inside its article, and its main
    part sometimes under another of the usual names."""
    found = found[:LEARN_BLOCKS]
    labels = [told(b.path) for b in found]
    if r.random() < 0.5:
        name = BODY_PARTS[r.integers(len(BODY_PARTS))]
        new = (name,) if name[0] != "." else ("div", name)
        found = [Block(b.text, tuple(new if set(e) & BODY else e for e in b.path), b.linked) for b in found]
    text = " ".join(b.text for b in found)[:20_000]
    for _ in range(r.integers(0, 4)):
        at = int(r.integers(len(found) + 1))
        under = found[at - 1].path[:-1] if at and r.random() < 0.7 else (("html",), ("body",))
        part = [Block(b.text, under + b.path, b.linked) for b in _parts(r, text)]
        found, labels = found[:at] + part + found[at:], labels[:at] + [0] * len(part) + labels[at:]
    return found, np.array(labels, np.float32)


def plain_page(r: np.random.Generator) -> list[Block]:
    """A page of an article alone, in made-up words, so that there is something to learn from whatever the sample."""
    def sentence() -> str:
        return " ".join("".join(r.choice(list("aeinorst"), int(r.integers(2, 9)))) for _ in range(r.integers(3, 50))) + "."

    return [Block(sentence(), (("html",), ("body",), ("article",), ("p",)), 0) for _ in range(r.integers(1, 12))]


def learn(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", rows: int = LEARN_PAGES) -> Labeller:
    """From at most about `rows` pages that have a part told to be main text, and PLAIN_PAGES made-up ones."""
    few = sample(pages.filter(F.col(html_col).isNotNull()), id_col, rows).select(id_col, html_col).toArrow().to_pylist()
    model, r = Labeller(), np.random.default_rng(9)
    made = [lesson(r, plain_page(r)) for _ in range(PLAIN_PAGES)]
    for row in sorted(few, key=lambda x: str(x[id_col])):
        found = blocks(row[html_col])
        if any(told(b.path) for b in found[:LEARN_BLOCKS]):
            made += [lesson(r, found) for _ in range(2)]
    rounds = max(12, min(60, 4_000 // len(made)))
    model.fit(code([b for b, _ in made]), [y for _, y in made], rounds)
    return model


def extract(pages: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (the main blocks joined by a newline), n_chars (code points).

    Null and empty pages, and pages without a main block, have an empty text.  Repeated rows come out
    repeated, null ids and urls stay null, other columns are not read.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [blocks(x or "") for x in part.column("html").to_pylist()]
                texts = ["\n".join(b.text for b, main in zip(own, marks) if main)
                         for own, marks in zip(found, model.main(found))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
