"""Personal data by candidates and gradient boosting.

Generators with high recall propose overlapping spans per kind.  Boosted trees, in numpy, score a
proposal from its format and its context; they learn from a bounded sample: strict spans, written in looser forms in
their own place, are right, and numbers that nothing speaks for are wrong.  Spans of the strict patterns always stay, and proposals above a calibrated threshold are
added where they overlap none of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import table
from gaugeline.llm.language import sample

KINDS = ("email", "ip", "card", "phone")
# The trees learn from at most so many documents, and so many proposals per kind of each, spread evenly.
LEARN_DOCS = 20_000
LEARN_PER_DOC = 20
# A proposal is added only if proposals scored like it were right this often, with this many to tell from.
PRECISION = 0.98
LEAST_SAMPLES = 40

DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match always starts where its run of digits starts, so the look-behind only saves time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){2,}"),
    "card": re.compile(r"[0-9](?:[\x20.-]?[0-9]){10,}"),
    "phone": re.compile(r"\+?\(?[0-9][\x20().0-9-]{5,}[0-9]"),
}
HINTS = ("tel", "phone", "call", "fax", "mobile", "mail", "contact", "card", "visa", "ip", "host", "addr")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL, found from each @ so that other text costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(m.span())
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))
    return out


def strict(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the strict patterns, (start, end) in code points."""
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def proposals(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans that may be of a kind: loose matches, and for numbers also each match without its outer groups."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text or "at]" in text or "at)" in text:
        out["email"] = _loose_emails(text)
    if DIGIT.search(text):
        for kind in KINDS[1:]:
            for m in LOOSE[kind].finditer(text):
                start, end = m.span()
                out[kind].append((start, end))
                if " " in m[0] and kind != "ip":
                    a, b = text.index(" ", start), text.rindex(" ", start, end)
                    out[kind] += [s for s in ((a + 1, end), (start, b)) if len(DIGIT.findall(text[s[0]:s[1]])) >= 7]
    return out


def _loose_emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for sign in re.finditer(r"@|\[at\]|\(at\)", text):
        start, end = sign.start(), sign.end()
        while start > done and not text[start - 1].isspace() and text[start - 1] not in "<>@,;:\"'":
            start -= 1
        while end < len(text) and not text[end].isspace() and text[end] not in "<>@,;:\"'":
            end += 1
        done = sign.end()
        if start < sign.start() and end > sign.end():
            out.append((start, end))
    return out


def _around(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def describe(text: str, start: int, end: int) -> list[float]:
    """Format and context of a proposal as numbers."""
    span = text[start:end]
    digits = "".join(DIGIT.findall(span))
    parts = [p for p in re.split(r"[^0-9]+", span) if p]
    before = text[max(0, start - 24):start].lower()
    tail = span.rpartition("@")[2]
    return [
        len(span), len(digits), len(set(digits)), len(parts), max((min(int(p[:6]), 99_999) for p in parts), default=0),
        max(map(len, parts), default=0), float(12 <= len(digits) <= 19 and luhn(digits)), span.count("-"), span.count("."),
        span.count(" "), span.count("("), float(span[0] == "+"), tail.count("."), sum(c.isalpha() for c in span[-4:]),
        _around(text[start - 1:start]), _around(text[end:end + 1]), float(any(h in before for h in HINTS)),
        float(span.isascii()), sum(c in LOCAL for c in span) / len(span)]


def _hinted(text: str, start: int) -> bool:
    before = text[max(0, start - 24):start].lower()
    return any(h in before for h in HINTS)


def rewritten(text: str, kind: str, start: int, end: int) -> list[tuple[str, int, int, bool]]:
    """A strict span in forms that the strict pattern of its kind misses, between the characters around it: text, start,
    end, and whether the form still is personal data."""
    span, groups = text[start:end], re.findall("[0-9]+", text[start:end])
    forms: list[tuple[str, bool]] = []
    if kind == "email":
        name, _, host = span.partition("@")
        forms = [(f"{name}(at){host}", True), (f"{name}[at]{host}", True), (f"{name}(at){host.replace('.', '')}", False)]
    elif kind == "phone":
        forms = [(span[1:].lstrip(" ()."), True), ("-".join(groups), True), (" ".join(groups), True)]
    elif kind == "card":
        digits = "".join(groups)
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)  # fails Luhn
        forms = [(".".join(d[k:k + 4] for k in range(0, len(d), 4)), d == digits) for d in (digits, wrong)]
    head, tail = text[max(0, start - 25):start], text[end:end + 1]
    return [(head + f + tail, len(head), len(head) + len(f), right) for f, right in forms]


def lessons(text: str) -> Iterator[tuple[str, bool, list[float]]]:
    """(kind, right, numbers) of a text's proposals.

    Right are its strict spans in loose forms.  Wrong are proposals that hold personal data of another
    kind, and those that are not strict where no word before them hints at a kind.  What a hint speaks
    for, and addresses with (at), are left out, as nobody knows.
    """
    known, loose = strict(text), proposals(text)
    for kind in KINDS:
        others = [known[k] for k in KINDS if k != kind]
        spare = [s for s in loose[kind] if not _overlaps(s, known[kind])
                 and (any(_overlaps(s, o) for o in others) or not _hinted(text, s[0]))
                 and (kind != "email" or "@" in text[s[0]:s[1]])]
        for s in spare[::max(1, len(spare) // LEARN_PER_DOC)]:
            yield kind, False, describe(text, *s)
        for s in known[kind][::max(1, len(known[kind]) // LEARN_PER_DOC)]:
            for form, start, end, right in rewritten(text, kind, *s):
                yield kind, right, describe(form, start, end)
                found = proposals(form)
                for other in KINDS[1:]:
                    if other != kind:
                        yield from ((other, False, describe(form, *p)) for p in found[other] if _overlaps(p, [(start, end)]))


@dataclass
class Trees:
    """Boosted regression trees on binned numbers; a tree is a list of (feature, bin) per level and leaf values."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]] = field(default_factory=list)
    threshold: float = 2.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.zeros(len(x))
        b = self.binned(x)
        z = np.full(len(x), self.base)
        for levels, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in levels:
                node = 2 * node + (b[np.arange(len(x)), feature[node]] > cut[node])
            z += leaves[node]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16) -> Trees:
    """Newton boosting of the logistic loss; a fifth of the rows sets the threshold."""
    model = Trees()
    if len(y) < LEAST_SAMPLES or y.min() == y.max():
        return model  # nothing to tell apart: only the strict spans
    aside = np.arange(len(y)) % 5 == 0
    x_fit, y_fit = x[~aside], y[~aside]
    model.edges = [np.unique(np.quantile(x_fit[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    share = np.clip(y_fit.mean(), 0.01, 0.99)
    model.base = float(np.log(share / (1 - share)))
    b, z = model.binned(x_fit), np.full(len(y_fit), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y_fit - p, p * (1 - p)
        node, levels = np.zeros(len(z), np.int64), []
        for level in range(depth):
            nodes = 1 << level
            best = np.full(nodes, -1.0)
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, bins, np.int64)
            for k in range(x.shape[1]):
                at = node * (bins + 1) + b[:, k]
                gs, hs = (np.bincount(at, v, nodes * (bins + 1)).reshape(nodes, -1) for v in (g, h))
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                top = gain.argmax(1)
                better = gain[np.arange(nodes), top] > best + 1e-9
                best[better] = gain[np.arange(nodes), top][better]
                feature[better], cut[better] = k, top[better]
            levels.append((feature, cut))
            node = 2 * node + (b[np.arange(len(z)), feature[node]] > cut[node])
        leaves = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
        model.trees.append((levels, leaves))
        z += leaves[node]
    p, truth = model.score(x[aside]), y[aside]
    ranked = np.argsort(-p, kind="stable")
    good = np.flatnonzero(np.cumsum(truth[ranked]) >= PRECISION * np.arange(1, len(p) + 1))
    if len(good) and good[-1] + 1 >= LEAST_SAMPLES // 5:
        model.threshold = max(0.5, float(p[ranked[good[-1]]]))
    return model


def learn(docs: DataFrame, rows: int = LEARN_DOCS) -> dict[str, Trees]:
    """Trees per kind from the lessons of a bounded sample of `docs` (doc_id, text)."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for text in batch.column("text").to_pylist() if text for row in lessons(text)]
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()),
                 pa.array(columns[2], pa.list_(pa.float64()))], ["kind", "right", "x"])

    few = sample(docs, "doc_id", rows).select("doc_id", "text")
    made = few.mapInArrow(collect, "kind string, right boolean, x array<double>").toArrow().to_pylist()
    made.sort(key=lambda r: (r["kind"], r["x"], r["right"]))
    out = {}
    for kind in KINDS:
        own = [r for r in made if r["kind"] == kind]
        out[kind] = boost(np.array([r["x"] for r in own]), np.array([r["right"] for r in own], np.float64)) if own else Trees()
    return out


def redactions(text: str, models: dict[str, Trees]) -> tuple[dict, list[tuple[int, str, int]]]:
    """The strict spans by kind, and all spans as (start, kind, end) by start and then kind."""
    base = strict(text)
    chosen = [(s, kind, e) for kind in KINDS for s, e in base[kind]]
    loose = proposals(text)
    for kind in KINDS:
        taken = sorted(base[kind])
        open_spans = [s for s in dict.fromkeys(loose[kind]) if not _overlaps(s, taken)]
        if not open_spans or models[kind].threshold > 1:
            continue
        p = models[kind].score(np.array([describe(text, *s) for s in open_spans]))
        added: list[tuple[int, int]] = []
        for k in sorted(range(len(p)), key=lambda k: (-p[k], open_spans[k])):
            if p[k] >= models[kind].threshold and not _overlaps(open_spans[k], added):
                added = sorted([*added, open_spans[k]])
        chosen += [(s, kind, e) for s, e in added]
    return base, sorted(chosen, key=lambda x: (x[0], KINDS.index(x[1])))


def _overlaps(span: tuple[int, int], ordered: list[tuple[int, int]]) -> bool:
    low, high = 0, len(ordered)  # the last one that starts before the span's end
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if ordered[mid][0] < span[1] else (low, mid)
    return low > 0 and ordered[low - 1][1] > span[0]


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, models: dict[str, Trees], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the strict spans, and `spans`, all of them.

    A span is kind:start:end in code points, end exclusive; spans are in order of start, then kind, joined by commas.
    Null text counts as empty.  Repeated rows come out repeated, null ids stay null, other columns are not read.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                base, spans = redactions(text.as_py() or "", models)
                own = sorted(((s, k, e) for k in KINDS for s, e in base[k]), key=lambda x: (x[0], KINDS.index(x[1])))
                out.append((*[len(base[k]) for k in KINDS], hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS)
                           + ", base_sha256 string, spans string")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, learn(docs))
