"""Averaged hashed subword embeddings with a linear softmax, in numpy.

A text is the bag of its words' features: the word itself, its character n-grams, and (if asked for) pairs of
neighbouring words, each hashed to a bucket with a learned vector.  The vectors are averaged and a linear
layer with softmax follows.  As the layer is linear, scoring needs one number per bucket
and class, so a text of any length is scored as a sum over its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MULTIPLY, _MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_START, _END, _PAIR, _TWICE = 2, 3, U(0x632BE59BD9B4E019), U(0x2545F4914F6CDD1D)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * _MIX
    h = (h ^ (h >> U(29))) * _MULTIPLY
    return h ^ (h >> U(32))


@dataclass(frozen=True)
class Shape:
    """What a text is cut into.  bits: 2^bits buckets; grams: n-gram lengths; pairs: neighbouring words too."""

    bits: int = 17
    grams: tuple[int, ...] = (2, 3, 4)
    pairs: bool = False
    lower: bool = False


@dataclass
class Words:
    """Texts as word codes: `bounds[i]:bounds[i + 1]` are those of text i in `codes`, which point into `unique`."""

    codes: np.ndarray
    bounds: np.ndarray
    unique: pa.Array


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Divided by ASCII white space; null texts have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    bounds = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))).astype(np.int64)
    filled = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not filled.all():  # white space at either end of a text leaves empty words
        flat = flat.filter(pa.array(filled))
        bounds = np.append(0, np.cumsum(filled))[bounds]
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, coded.dictionary)


def _marked(unique: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with a mark before and after each; the word and the place in it of each."""
    sizes = pc.utf8_length(unique).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(unique.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + 2)
    starts = ends - sizes - 2
    marked = np.full(ends[-1] if len(ends) else 0, _END, np.uint64)
    marked[starts] = _START
    inner = np.ones(len(marked), bool)
    inner[starts] = inner[ends - 1] = False
    marked[inner] = chars
    return marked, np.repeat(np.arange(len(sizes)), sizes + 2), starts


def word_hashes(unique: pa.Array) -> np.ndarray:
    """A 64-bit hash per word, of its code points and their places."""
    if not len(unique):
        return np.zeros(0, U)
    marked, word, starts = _marked(unique)
    place = (np.arange(len(marked)) - starts[word]).astype(U)
    return mixed(np.add.reduceat(mixed(mixed(marked) + place * _PAIR), starts))


def features_of(unique: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket) of every feature of every word, and a hash per word."""
    n = len(unique)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    marked, word, _ = _marked(unique)
    whole = word_hashes(unique)
    shift = U(64 - shape.bits)
    of, bucket = [np.arange(n)], [whole >> shift]
    h = np.zeros(len(marked), U)
    for k in range(max(shape.grams)):
        if k >= len(marked):
            break
        h = h[: len(marked) - k] * _MULTIPLY + marked[k:] + U(k + 1)
        if k + 1 in shape.grams:
            inside = word[: len(h)] == word[k:]
            of.append(word[: len(h)][inside])
            bucket.append(mixed(h[inside]) >> shift)
    return np.concatenate(of), np.concatenate(bucket).astype(np.int64), whole


def pair_buckets(codes: np.ndarray, whole: np.ndarray, shape: Shape) -> np.ndarray:
    """Bucket of each word with the next one; a word that is said twice has one bucket whatever the word."""
    a, b = whole[codes[:-1]], whole[codes[1:]]
    joined = np.where(codes[:-1] == codes[1:], _TWICE, a * _PAIR + b)
    return (mixed(joined) >> U(64 - shape.bits)).astype(np.int64)


def bags(texts: pa.Array, shape: Shape, most_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For training: buckets and their shares per text, from `most_words` words spread evenly over it."""
    words = words_of(texts, shape.lower)
    of, bucket, whole = features_of(words.unique, shape)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(words.unique) + 1))
    bucket = bucket[order]
    out = []
    for start, end in zip(words.bounds, words.bounds[1:]):
        # Whole stretches of 20 words, so that pairs stay together.
        blocks = np.arange(start, end, 20)
        if len(blocks) * 20 > most_words:
            blocks = blocks[np.linspace(0, len(blocks) - 1, max(1, most_words // 20)).astype(int)]
        parts = []
        for b in blocks:
            codes = words.codes[b:min(b + 20, end)]
            parts += [bucket[first[c]:first[c + 1]] for c in codes]
            if shape.pairs and len(codes) > 1:
                parts.append(pair_buckets(codes, whole, shape))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ids, counts = np.unique(ids, return_counts=True)
        out.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


@dataclass
class Model:
    """Scores per bucket and class, class names, temperature, and the bound under which a prediction is rejected."""

    shape: Shape
    classes: list
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        """One row per text, from all its words; texts without a word have the bias alone."""
        words = words_of(texts, self.shape.lower)
        of, bucket, whole = features_of(words.unique, self.shape)
        total = np.zeros((len(texts), len(self.classes)))
        if not len(words.codes):
            return total + self.bias
        n = len(words.unique)
        size = np.bincount(of, minlength=n)
        starts, filled = words.bounds[:-1], np.diff(words.bounds) > 0
        weight = np.zeros(len(texts))
        weight[filled] = np.add.reduceat(size[words.codes], starts[filled])
        pairs = None
        if self.shape.pairs and len(words.codes) > 1:
            pairs = np.append(pair_buckets(words.codes, whole, self.shape), 0)
            inside = np.ones(len(words.codes), bool)
            inside[words.bounds[1:][filled] - 1] = False  # a text's last word has no next one
            weight[filled] += np.add.reduceat(inside.astype(np.int64), starts[filled])
        for c in range(len(self.classes)):
            per_word = np.bincount(of, self.table[bucket, c], minlength=n)[words.codes]
            if pairs is not None:
                per_word = per_word + np.where(inside, self.table[pairs, c], 0)
            total[filled, c] = np.add.reduceat(per_word, starts[filled])
        return total / np.maximum(weight, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
        return z / z.sum(1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: list, shape: Shape, dim: int = 16,
          rounds: int = 12, rate: float = 0.5, seed: int = 7, balance: bool = False) -> Model:
    """Stochastic gradient descent on the cross entropy, one text at a time, the rate falling to zero.

    A tenth of the samples is set aside: it fixes the temperature (least cross entropy)
    and the accept bound (the lowest at which 99 % of accepted predictions are right).
    balance: texts of rare classes count more.  Without samples the model has no classes.
    """
    random = np.random.default_rng(seed)
    classes = sorted(set(labels))
    target = np.array([classes.index(x) for x in labels], np.int64)
    vectors = (random.random((1 << shape.bits, dim), np.float32) - 0.5) / dim
    layer, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    order = random.permutation(len(samples))
    aside, learn = order[: len(order) // 10], order[len(order) // 10:]
    share = np.bincount(target, minlength=len(classes)) / max(1, len(target))
    worth = 1 / (len(classes) * np.maximum(share, 1e-9)) if balance else np.ones(len(classes))
    steps, done = rounds * len(learn), 0
    for _ in range(rounds):
        for i in random.permutation(learn):
            ids, weights = samples[i]
            step = np.float32(rate * (1 - done / steps) * worth[target[i]])
            done += 1
            mean = weights @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            # Averages make small gradients; a longer step on the vectors makes up for it.
            vectors[ids] -= (step * 30) * weights[:, None] * back
    model = Model(shape, classes, (vectors @ layer).astype(np.float64), bias.astype(np.float64))
    if len(aside):
        z = np.array([samples[i][1] @ model.table[samples[i][0]] + model.bias for i in aside])
        truth = target[aside]
        heat = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(np.maximum(model.probabilities(z)[np.arange(len(z)), truth], 1e-12)).mean())

        model.temperature = min(heat, key=loss)
        p = model.probabilities(z)
        sure, right = p.max(1), p.argmax(1) == truth
        ranked = np.argsort(-sure)
        good = np.flatnonzero(np.cumsum(right[ranked]) >= 0.99 * np.arange(1, len(z) + 1))
        model.accept = float(sure[ranked[good[-1]]]) if len(good) else 1.0
    return model
