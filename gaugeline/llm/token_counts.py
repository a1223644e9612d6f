"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes.  Every node has a failure link and the number of pieces that are
popped when it is followed: greedy longest match of any word then takes one pass over
its bytes, and pieces are counted without being built.  All distinct words of a slice step through the
automaton together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import slices, table
from gaugeline.llm.subword import words_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_WORD = 256


@dataclass
class Automaton:
    """keys: node * 256 + byte, ascending, with the node each leads to; fail and pops: per node.  Node 0 is the root."""

    keys: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    pops: np.ndarray

    def goto(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def count(self, words: pa.Array) -> np.ndarray:
        """Pieces of each word, which starts with a space as in running text."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer("".join(words.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
        state = np.full(len(sizes), self.goto(np.zeros(1, np.int64), np.full(1, 32))[0])
        pieces = np.zeros(len(sizes), np.int64)
        # Longest first, so that the words still running are the first ones.
        order = np.argsort(-sizes, kind="stable")
        starts, ordered = (ends - sizes)[order], sizes[order]
        longest = int(ordered[0]) if len(ordered) else 0
        for t in range(min(longest, LONG_WORD)):
            n = int(np.searchsorted(-ordered, -t))  # words with more than t bytes
            self._step(state[:n], pieces[:n], data[starts[:n] + t])
        for w in range(int(np.searchsorted(-ordered, -LONG_WORD))):
            state[w], pieces[w] = self._walk(int(state[w]), int(pieces[w]),
                                             data[starts[w] + LONG_WORD:starts[w] + ordered[w]].tobytes())
        live = np.flatnonzero(state)
        while len(live):
            pieces[live] += self.pops[state[live]]
            state[live] = self.fail[state[live]]
            live = live[state[live] > 0]
        out = np.empty_like(pieces)
        out[order] = pieces
        return out

    def _step(self, state: np.ndarray, pieces: np.ndarray, byte: np.ndarray) -> None:
        byte = byte.astype(np.int64)
        live = np.arange(len(state))
        while len(live):
            to = self.goto(state[live], byte[live])
            stuck = to < 0
            state[live[~stuck]] = to[~stuck]
            live = live[stuck]
            pieces[live] += self.pops[state[live]]
            state[live] = self.fail[state[live]]

    def _walk(self, state: int, pieces: int, data: bytes) -> tuple[int, int]:
        if not hasattr(self, "_next"):
            self._next = dict(zip(self.keys.tolist(), self.to.tolist()))
        for byte in data:
            while (to := self._next.get(state * 256 + byte)) is None:
                pieces += int(self.pops[state])
                state = int(self.fail[state])
            state = to
        return state, pieces


def build(pieces: list[bytes]) -> Automaton:
    """The automaton of a vocabulary that holds every single byte, so that no word is without pieces.

    A node that is a piece pops it and goes back to the root.  Any other node takes its
    parent's link and follows links, popping on the way, until its byte leads on.
    """
    have = set(pieces)
    if not all(bytes([b]) in have for b in range(256)):
        raise ValueError("the vocabulary must hold all single bytes")
    node, parent, last, whole = {b"": 0}, [0], [0], [False]
    for piece in sorted(have, key=len):
        at = 0
        for end in range(1, len(piece) + 1):
            head = piece[:end]
            if head not in node:
                node[head] = len(parent)
                parent.append(at)
                last.append(head[-1])
                whole.append(head in have)
            at = node[head]
    edges = {parent[v] * 256 + last[v]: v for v in range(1, len(parent))}
    depth = [0] * len(parent)
    for v in range(1, len(parent)):
        depth[v] = depth[parent[v]] + 1
    fail, pops = [0] * len(parent), [0] * len(parent)
    for v in sorted(range(1, len(parent)), key=depth.__getitem__):
        if whole[v]:
            pops[v] = 1
            continue
        popped, back = pops[parent[v]], fail[parent[v]]
        while back * 256 + last[v] not in edges:
            popped += pops[back]
            back = fail[back]
        fail[v], pops[v] = edges[back * 256 + last[v]], popped
    keys = np.array(sorted(edges), np.int64)
    return Automaton(keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(fail, np.int64),
                     np.array(pops, np.int64))


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a file with lines of a base64 piece and its number."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def token_counts(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens.

    Words are divided by ASCII white space, and each is matched greedily with a leading space; the
    white space itself is not counted further.  Null and empty texts have 0 of both.  Repeated rows come
    out repeated, null ids stay null, other columns are not read.  The automaton is sent to the executors
    once; its size is that of the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16_000_000):
                words = words_of(part.column("text"))
                per_word = shared.value.count(words.unique)[words.codes]
                total = np.append(0, np.cumsum(per_word))[words.bounds]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(words.bounds)), pa.array(np.diff(total))],
                    ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), build(read_vocabulary()))
