"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text (16 bytes of memory) and cuts where its top bits are
zero, so the same passage has the same cuts wherever it stands and insertions only change the chunks they touch.  Every
window of 50 words has a seed that its own bytes decide: the least digest of its whole chunks or, where cuts leave
none, of its stretches of 16 words.
Windows whose seed other documents have too are compared by a hash of all their bytes; each learns the least document
that holds it, and neighbouring windows with the same least holder make up a passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import Shelf, slices, table

CUT_BITS = 5
MIN_CHUNK_BYTES = 12
MIN_WORDS = 50
#: Bytes on which a cut depends.
MEMORY = 16
GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, np.uint16)
_P = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_P), -1, 1 << 64))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Chunk bounds of a text's bytes, from 0 to its length."""
    if not len(data):
        return np.zeros(1, np.int64)
    h = GEAR[data]
    for step in (1, 2, 4, 8):  # after these, each hash holds its 16 bytes, the older ones shifted out
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    inner = np.flatnonzero(h < (1 << (16 - CUT_BITS))) + 1
    inner = inner[inner < len(data)]
    return np.concatenate([[0], inner, [len(data)]])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), base)), dtype=np.uint64)


class Digests:
    """64-bit digests of any stretches of `data`, with their length mixed in; exact per content up to collisions."""

    def __init__(self, data: np.ndarray):
        self.sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * _powers(_P, len(data)), dtype=np.uint64))
        self.back = _powers(_BACK, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair of bounds; the largest number where that is empty."""
    out, size, span = np.full(len(low), _NONE), 1, high - low
    while size <= span.max(initial=0):
        here = (span >= size) & (span < 2 * size)
        out[here] = np.minimum(values[low[here]], values[high[here] - size])
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return out


def word_starts(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    return np.flatnonzero(~space & np.append(True, space[:-1]))


def word_ends(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    return np.flatnonzero(~space & np.append(space[1:], True)) + 1


@dataclass
class Windows:
    """All windows of so many words of some texts: the text's number, the first word's number in it, their bytes in it,
    a digest of them, and the seed."""

    text: np.ndarray
    no: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    seed: np.ndarray


def windows(texts: list[str], words: int) -> Windows:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)  # ends in a space, so that no word ends the data
    offset = np.cumsum([0, *[len(x) + 1 for x in parts]])
    begins, ends = word_starts(data), word_ends(data)
    text = np.searchsorted(offset, begins, "right") - 1
    at = np.flatnonzero(text[words - 1:] == text[:max(0, len(text) - words + 1)])
    start, end, digests = begins[at], ends[at + words - 1], Digests(data)
    of = text[at]
    return Windows(of, at - np.searchsorted(text, of), start - offset[of], end - offset[of],
                   digests.of(start, end).view(np.int64),
                   _seeds(data, digests, begins, ends, at, words).view(np.int64))


def _seeds(data: np.ndarray, digests: Digests, begins: np.ndarray, ends: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """The least digest among the chunks of a window whose two cuts depend on its own bytes alone, or among its
    stretches of a third of its words if there is no such chunk."""
    out = np.full(len(at), _NONE)
    bounds = cuts(data)[1:-1]
    if len(bounds) > 1:
        marks = digests.of(bounds[:-1], bounds[1:])
        marks[np.diff(bounds) < MIN_CHUNK_BYTES] = _NONE  # too short to mean something
        low = np.searchsorted(bounds, begins[at] + MEMORY)
        out = least(marks, low, np.maximum(low, np.searchsorted(bounds, ends[at + words - 1], "right") - 1))
    bare, few = np.flatnonzero(out == _NONE), max(1, words // 3)
    if len(bare):
        marks = digests.of(begins[:len(begins) - few + 1], ends[few - 1:])
        out[bare] = least(marks, at[bare], at[bare] + words - few + 1)
    return out


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def seeds(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, seed) of the windows of `min_words` words, once for neighbours with the same seed."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = windows(part.column("text").to_pylist(), min_words)
                new = np.append(True, (w.seed[1:] != w.seed[:-1]) | (w.text[1:] != w.text[:-1]))[:len(w.seed)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(w.text[new])), pa.array(w.seed[new])], ["doc_id", "seed"])

    return docs.mapInArrow(find, f"doc_id {_kind(docs)}, seed long")


def candidates(rows: DataFrame, min_words: int) -> DataFrame:
    """Windows whose seed is in the row's `seeds`: doc_id, key, no, start, size (bytes).

    rows: doc_id, text, seeds.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = windows(part.column("text").to_pylist(), min_words)
                known, edges = part.column("seeds"), np.searchsorted(w.text, np.arange(len(part) + 1))
                shared = np.concatenate([np.zeros(0, bool), *[
                    np.isin(w.seed[a:b], known[k].values.to_numpy(False))
                    for k, (a, b) in enumerate(zip(edges, edges[1:]))]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(w.text[shared])), pa.array(w.key[shared]),
                     *[pa.array(x[shared].astype(np.int32)) for x in (w.no, w.start, w.end - w.start)]],
                    ["doc_id", "key", "no", "start", "size"])

    return rows.mapInArrow(find, f"doc_id {_kind(rows)}, key long, no int, start int, size int")


def joined(shared: DataFrame, min_words: int) -> DataFrame:
    """Passages from the shared windows: neighbours in a document with the same `first`.

    The sort is by document, so it holds as many rows as one text has words."""
    order = Window.partitionBy("doc_id").orderBy("no")
    new = (F.col("no") - F.lag("no").over(order) == 1) & (F.col("first") == F.lag("first").over(order))
    runs = shared.withColumn("new", F.when(new, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start_byte"), F.max(F.col("start") + F.col("size")).alias("end_byte"),
        (F.count("*") + (min_words - 1)).cast("int").alias("n_words"), F.min("first").alias("first_doc_id")).select(
        "doc_id", "start_byte", "end_byte", "n_words", "first_doc_id", (F.col("first_doc_id") == F.col("doc_id")).alias("kept"))


def passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of `min_words` words or more whose windows of so many words all stand in other documents too.

    Per occurrence: doc_id, start_byte, end_byte (exclusive, in UTF-8), n_words, first_doc_id, kept.
    A passage is the longest stretch of neighbouring windows with the same least holder, first_doc_id, itself included; it is
    `kept` where that is its own document.  Every window that two documents hold is in one passage of each of
    them, and neighbouring passages with different holders overlap.  With all passages cut that are not kept, every word of
    a repeated window still stands in its least holder, or in turn in the least holder of a window that overlaps it there.

    White space divides words and counts like other bytes between them.  Repeats inside one document alone do not count,
    nor do rows repeated under one id, of whose texts the least counts.  Ids are of any type that has an order.  Null and
    empty texts, null ids and empty tables give no rows; other columns are not read.

    None is missed and there is no limit on holders.  Only the least and greatest holder of a window are looked for, which
    is added up before the shuffle; adaptive execution splits the join back at windows that very many documents hold.
    """
    shelf = Shelf(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(
        "doc_id is not null and length(text) > 0")
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    ends = [F.min("doc_id").alias("first"), F.max("doc_id").alias("last")]
    sown = shelf.put(seeds(rows, min_words), "seeds")
    held = sown.groupBy("seed").agg(*ends).filter("first < last").select("seed")
    wanted = sown.join(held, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    wanted = shelf.put(wanted, "wanted")
    shelf.drop("seeds")
    spots = candidates(rows.join(wanted, "doc_id"), min_words)
    agreed = shelf.put(spots.groupBy("key").agg(*ends).filter("first < last").select("key", "first"), "agreed")
    # Keys are single in `agreed`, so a hash table of a partition of it is small, and the many windows need no sort.
    found = shelf.put(joined(spots.join(agreed.hint("shuffle_hash"), "key"), min_words), "passages")
    shelf.drop("wanted", "agreed")
    return found


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and text with every passage that is not `kept` cut out.  docs: doc_id, text; rows repeated under one id
    should be one row before, as positions are those of one text."""
    spans = found.filter("not kept").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if text is not None and own:
                    data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
                    for s in own:
                        kept.append(data[at:max(at, s["start_byte"])])
                        at = max(at, s["end_byte"])
                    text = b"".join([*kept, data[at:]]).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").join(spans, "doc_id", "left").mapInArrow(
        cut, f"doc_id {_kind(docs)}, text string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
