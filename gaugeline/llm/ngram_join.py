"""Jaccard join on word 5-grams with adaptive multi-match prefixes, and its components.

1. Counting.  Every task sorts its shingles (32 bits of their hash) into ranges of packed, compressed arrays; one task per
   range adds them up.  The most frequent shingles, a bounded number of them, get a frequency class.
2. Prefixes.  A document's distinct shingles are ordered by (class, hash).  Two documents that link share at least
   one shingle among the first n - t + 1 of each, t = ceil(0.8 n), and at least l among the first n - t + l.
   Each document takes the l with the least estimated cost: the rows that its prefix meets plus the candidates left
   to verify.  A pair must share min(l, l') shingles in the prefixes of that length.
3. Documents with equal sets become one.  Rounds of stars compare the bucket of each prefix shingle with one leader and join
   what links, so a group of near copies costs rows in proportion to its size.  Then all pairs that are still in different
   components and share a bucket enough are compared; no pair that links can be missed.
4. A candidate passes length, position and parity tests (each exact) before its full sets are intersected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import Shelf, if_small, shuffles_dropped, slices, small_batches, table, those_of, unused
from gaugeline.llm.subword import mixed, word_hashes, words_of
from gaugeline.operators.neighbors import connected_components

GRAM = 5
PERCENT = 80
#: Shingles that get a frequency class: the most frequent ones, at most so many (5 bytes each).
KNOWN = 1 << 20
LEAST_COUNT = 4
RANGE_SHINGLES = 2_000_000
#: Longest multi-match, and the cost of a comparison against that of meeting a row in a bucket.
MOST_MATCHES = 4
VERIFY_COST = 8.0
PARITY_LONGS = 8
MOST_ROUNDS = 6
_CLASSED = np.uint64(1) << np.uint64(58)
#: Bytes of whole sets that may be broadcast.
SET_BYTES = 4 << 20
#: Pairs of sets that a task holds at a time.
PAIR_ROWS = 256
U = np.uint64


def shingles_of(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingles of `gram` words of all texts in order, and the bounds of each text's own.

    Words are divided by ASCII white space, A-Z in lower case.  A text of fewer words is one shingle of its own kind.
    """
    words = words_of(pc.ascii_lower(texts.cast(pa.large_string())))
    own = word_hashes(words.unique)[words.codes] if len(words.codes) else np.zeros(0, U)
    odd = U(0x9E3779B97F4A7C15)
    grams = np.full(max(0, len(own) - gram + 1), gram, U)
    for k in range(gram):
        grams *= odd
        grams += own[k:k + len(grams)]
    grams = mixed(grams)
    counts = np.diff(words.bounds)
    last = np.repeat(words.bounds[1:] - gram, counts)  # where the last shingle of a word's text starts
    grams = grams[(np.arange(len(own)) <= last)[:len(grams)]]
    sizes = np.maximum(counts - gram + 1, 0)
    few = np.flatnonzero((counts > 0) & (counts < gram))
    if len(few):
        whole = counts[few].astype(U)
        for k in range(gram - 1):
            there = counts[few] > k
            whole[there] = whole[there] * odd + own[words.bounds[few[there]] + k]
        grams = np.insert(grams, np.cumsum(sizes)[few], mixed(whole))
        sizes[few] = 1
    return grams, np.append(0, np.cumsum(sizes))


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each part ascending and once, and the new bounds.  Sorts `values` itself."""
    for start, end in zip(bounds.tolist(), bounds[1:].tolist()):
        values[start:end].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][bounds[:-1] < len(values)]] = True
    return values[keep], np.append(0, np.cumsum(keep))[bounds]


def shingle_sets(texts: pa.Array, gram: int = GRAM) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, ascending."""
    flat, bounds = distinct(*shingles_of(texts, gram))
    return iter(np.split(flat, bounds[1:-1]))


def _pack(tokens: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, and their counts, compressed."""
    raw = np.diff(tokens, prepend=np.uint32(0)).astype(np.uint32).tobytes() + counts.astype(np.uint32).tobytes()
    return len(tokens).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    both = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], 8 * n, asbytes=True), np.uint32)
    return np.cumsum(both[:n], dtype=np.uint32), both[n:]


def frequent(docs: DataFrame, most: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, 32 bits of their hashes ascending, and floor(log2(documents)) of each.

    All documents are counted.  The list is cut at a class, so that at most `most` shingles are in it.
    """
    shelf = Shelf(docs.sparkSession)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(16, -(-chars // (6 * RANGE_SHINGLES)))
    width = -(-(1 << 32) // ranges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(tokens, np.arange(1, ranges, dtype=np.int64) * width)
            blobs = [_pack(t, c) for t, c in zip(np.split(tokens, cut), np.split(counts, cut))]
            return pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array(blobs, pa.binary())],
                                              ["range", "packed"])

        for batch in batches:
            for part in slices(batch, "text"):
                shingles, bounds = shingles_of(part.column("text"))
                held.append(distinct((shingles >> U(32)).astype(np.uint32), bounds)[0])
                size += len(held[-1])
                if size >= RANGE_SHINGLES:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(blob.as_py()) for batch in batches for blob in batch.column("packed")]
        tokens, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint32(1)))
        tokens, counts = tokens[first], np.add.reduceat(counts, first) if len(first) else counts
        often = counts >= LEAST_COUNT
        level = np.log2(counts[often]).astype(np.int32)
        sizes = np.bincount(level, minlength=64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([tokens[often].tobytes()], pa.binary()), pa.array([level.astype(np.uint8).tobytes()], pa.binary()),
             pa.array([sizes.tolist()], pa.list_(pa.int64()))], ["tokens", "levels", "sizes"])

    counted = shelf.put(
        docs.select("text").mapInArrow(count, "range int, packed binary").groupBy("range")
        .applyInArrow(add, "tokens binary, levels binary, sizes array<bigint>"), "counts")
    sizes = counted.select(F.posexplode("sizes").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    per_level = np.zeros(64, np.int64)
    for row in sizes:
        per_level[row["level"]] = row["n"]
    above = per_level[::-1].cumsum()[::-1]  # shingles of this class or a higher one
    least = int(np.argmax(above <= most))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, v in zip(batch.column("tokens"), batch.column("levels")):
                tokens, levels = np.frombuffer(t.as_py(), np.uint32), np.frombuffer(v.as_py(), np.uint8)
                keep = levels >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tokens[keep].tobytes()], pa.binary()), pa.array([levels[keep].tobytes()], pa.binary())],
                    ["tokens", "levels"])

    kept = counted.select("tokens", "levels").mapInArrow(top, "tokens binary, levels binary").toArrow()
    shelf.drop("counts")
    tokens = np.frombuffer(b"".join(kept["tokens"].to_pylist()), np.uint32)
    levels = np.frombuffer(b"".join(kept["levels"].to_pylist()), np.uint8)
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def ordered_sets(shingles: np.ndarray, bounds: np.ndarray, tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set as ascending numbers, the class in the top 6 bits and then the hash, and the bounds.  Rare shingles come first."""
    level = np.zeros(len(shingles), U)
    if len(tokens):
        high = (shingles >> U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(tokens, high), len(tokens) - 1)
        level = np.where(tokens[at] == high, levels[at], 0).astype(U)
    return distinct((level << U(58)) | (shingles >> U(6)), bounds)


def skipped(n: np.ndarray) -> np.ndarray:
    """How many of n shingles a set can lack and still link: n - ceil(0.8 n)."""
    return n - (PERCENT * n + 99) // 100


def best_matches(ordered: np.ndarray) -> int:
    """The l that costs least: rows met by the prefix, and candidates to verify, which fall as l grows."""
    n = len(ordered)
    short = int(skipped(np.int64(n)))
    most = min(MOST_MATCHES, n - short)
    met = np.cumsum(np.exp2((ordered[:short + most] >> U(58)).astype(np.float64)) - 1)
    costs = [met[short + l - 1] * (1 + VERIFY_COST / l**2) + l for l in range(1, most + 1)]
    return 1 + int(np.argmin(costs))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each part, modulo 2^64."""
    total = np.append(U(0), np.cumsum(values, dtype=U))
    return total[bounds[1:]] - total[bounds[:-1]]


def parities(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """512 bits per set, each the parity of the shingles that fall on it: two sets differ in at least as many shingles as bits."""
    width, n = 64 * PARITY_LONGS, len(bounds) - 1
    spot = ((flat * U(0xD6E8FEB86659FD93)) >> U(64 - 9)).astype(np.int64)
    bits = np.bincount(np.repeat(np.arange(n), np.diff(bounds)) * width + spot, minlength=n * width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(n, PARITY_LONGS)


def prefixes(docs: DataFrame, known) -> DataFrame:
    """doc_id, n, sign (two hashes of the set), matches (l), rare (prefix shingles without a class), prefix, parity.
    known: the broadcast list."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "sign", "matches", "rare", "prefix", "parity"]
        tokens, levels = known.value
        for batch in batches:
            for part in slices(batch, "text"):
                flat, bounds = ordered_sets(*shingles_of(part.column("text")), tokens, levels)
                n = np.diff(bounds)
                short = skipped(n)
                matches = np.minimum(n, 1)
                # Only where a longer prefix may reach a known shingle is there anything to weigh.
                ends = bounds[:-1] + short + np.minimum(MOST_MATCHES, n - short)
                for k in np.flatnonzero(n):
                    if flat[ends[k] - 1] >= _CLASSED:
                        matches[k] = best_matches(flat[bounds[k]:bounds[k + 1]])
                size = np.where(n > 0, short + matches, 0)
                inside = np.arange(len(flat)) - np.repeat(bounds[:-1], n) < np.repeat(size, n)
                head, heads = flat[inside], np.append(0, np.cumsum(size))
                rare = np.append(0, np.cumsum(head < _CLASSED))[heads]
                signs = np.stack([_sums(mixed(flat), bounds), _sums(mixed(flat + U(77)), bounds)], 1).view(np.int64)

                def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))

                def fixed(rows: np.ndarray) -> pa.Array:
                    return lists(rows.reshape(-1), np.arange(len(rows) + 1) * rows.shape[1])

                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), fixed(signs), pa.array(matches, pa.int32()),
                     pa.array(np.diff(rare), pa.int32()), lists(head.view(np.int64), heads), fixed(parities(flat, bounds))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(make, f"doc_id {kind}, n long, sign array<bigint>, matches int, rare int, prefix array<bigint>, "
                           "parity array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the ascending shingles as bytes."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return docs.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set binary")


def linked(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sa, sb) of which 100 * intersection >= 80 * union."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(verify, f"a {kind}, b {kind}")


def _differing(a: str, b: str) -> Column:
    """Bits in which two parity arrays differ."""
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PARITY_LONGS)), F.lit(0))


def _alike(a: str, b: str, na: Column, nb: Column) -> Column:
    """Parity test: sets that link differ in at most na + nb - 2 * overlap shingles, so in no more bits."""
    return _differing(a, b) <= na + nb - 2 * _overlap_needed(na, nb)


def _overlap_needed(na: Column, nb: Column) -> Column:
    """The least intersection of sets that link: 180 * common >= 80 * (na + nb)."""
    return F.ceil(F.lit(PERCENT) * (na + nb) / F.lit(100 + PERCENT)).cast("long")


def _possible(x: str, y: str) -> Column:
    """Length and position tests of two rows of one bucket: what can still be shared before, at and after it."""
    c = {s: {f: F.col(f"{s}.{f}") for f in ("n", "at")} for s in (x, y)}
    a, b = c[x], c[y]
    most = F.least(a["at"], b["at"]) + F.least(a["n"] - a["at"], b["n"] - b["at"])
    return ((a["n"] * PERCENT <= b["n"] * 100) & (b["n"] * PERCENT <= a["n"] * 100)
            & (most >= _overlap_needed(a["n"], b["n"])))


def merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """(doc_id, component) of all that has had a link: the components so far, joined where the new links (a, b) connect them.

    The new links become edges between components, so links of earlier rounds are not followed again.  A component is
    named by its smallest document; documents without links so far are not in the table.
    """
    if component is None:
        ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return connected_components(ends, links).select(F.col("id").alias("doc_id"), "component")
    before = if_small(component)
    for end in "ab":
        links = links.join(before.select(F.col("doc_id").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    edges = links.select(*[F.coalesce(f"c{end}", end).alias(end) for end in "ab"])
    joined = connected_components(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges)
    new = joined.select(F.col("id").alias("doc_id"), "component").join(before.select("doc_id"), "doc_id", "left_anti")
    moved = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return component.join(if_small(moved), "component", "left").select(
        "doc_id", F.coalesce("to", "component").alias("component")).unionByName(new)


class _Join:
    """The tables of one join: rows of buckets, what is known of each document, its text, and its component so far.
    `single` keeps one row per id."""

    def __init__(self, shelf: Shelf, rows: DataFrame, facts: DataFrame, texts: DataFrame, single: Callable[[DataFrame], DataFrame]):
        self.shelf, self.rows, self.facts, self.texts, self.single = shelf, rows, facts, texts, single
        self.component = None
        self.step = 0

    def placed(self) -> DataFrame:
        """Bucket rows with their component; buckets of one component are gone."""
        if self.component is None:
            return self.rows.withColumn("component", F.col("doc_id"))
        rows = self.rows.join(if_small(self.component), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id"))
        open_buckets = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
        return rows.join(if_small(open_buckets.select("token")), "token", "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass the parity test and link.  Sets are made for documents of such pairs only."""
        own = {s: self.facts.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("parity").alias(f"p{s}"))
               for s in "ab"}
        near = pairs.join(if_small(own["a"], 100_000), "a").join(if_small(own["b"], 100_000), "b")
        near = near.filter(_alike("pa", "pb", F.col("na"), F.col("nb")))
        near = self.shelf.put(near.select("a", "b"), f"near{self.step}")
        ids = self.shelf.put(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"ids{self.step}")
        sets = self.shelf.put(self.single(full_sets(those_of(self.texts, "doc_id", ids))), f"sets{self.step}")
        if (sets.agg(F.sum(F.length("set"))).first()[0] or 0) <= SET_BYTES:
            sets = F.broadcast(sets)
        held = {s: sets.select(F.col("doc_id").alias(s), F.col("set").alias(f"s{s}")) for s in "ab"}
        return linked(near.join(held["a"], "a").join(held["b"], "b"))

    def add(self, found: DataFrame) -> bool:
        """Join what the new links connect; says whether there were any."""
        self.step += 1
        with small_batches(found.sparkSession, PAIR_ROWS):
            more = self.shelf.put(found, f"links{self.step}")
        self.shelf.drop(*[f"{name}{self.step - 1}" for name in ("near", "ids", "sets")])
        if more.isEmpty():
            return False
        self.component = self.shelf.put(merged(self.component, more), f"component{self.step}")
        self.shelf.drop(f"component{self.step - 1}", f"links{self.step}")
        return True


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Documents link when their sets of distinct 5-word shingles have a Jaccard similarity of 0.8 or more; component_id
    is the smallest id that links reach.  Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of one to four words
    has one shingle, the whole of it.  Null or empty texts have none and link with nothing.  Repeated rows come out
    repeated; a null id gets a null component and links nothing.  Other columns are not read.  An
    empty table gives no rows.  Shingles are compared by 64-bit hashes.
    """
    with small_batches(docs.sparkSession), shuffles_dropped(docs.sparkSession):
        return _components(docs, id_col, text_col, known)


def _components(docs: DataFrame, id_col: str, text_col: str, known: int) -> DataFrame:
    spark = docs.sparkSession
    shelf = Shelf(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(frequent(rows, known))
    made = shelf.put(prefixes(rows, shared), "prefixes")
    shared.destroy()

    # One document stands for all with the same set.
    real = made.filter("n > 0 and doc_id is not null")
    repeated = not real.groupBy("doc_id").count().filter("count > 1").isEmpty()

    def single(df: DataFrame) -> DataFrame:
        """One row per id; only rows repeated under one id make a shuffle necessary."""
        return df.dropDuplicates(["doc_id"]) if repeated else df

    groups = shelf.put(real.groupBy("n", "sign").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "groups")
    first = groups.select(F.col("first").alias("doc_id"))
    facts = shelf.put(single(real.join(if_small(first), "doc_id", "left_semi")).drop("sign"), "facts")
    signs = shelf.put(made.select("doc_id", "n", "sign"), "signs")
    shelf.drop("prefixes")

    # Rows of the buckets that hold two documents or more.  A document has a token once, so counts tell; what else
    # is known of it joins the few rows that are left.
    every = facts.select("doc_id", F.posexplode("prefix").alias("at", "token"))
    live = every.groupBy("token").count().filter("count > 1").select("token")
    met = shelf.put(every.join(live, "token", "left_semi"), "met")
    short = F.col("n") - F.floor((F.col("n") * PERCENT + 99) / 100)
    buckets = shelf.put(met.join(facts.select("doc_id", "n", "matches", "rare"), "doc_id").withColumn(
        "level", F.greatest(F.lit(1), F.col("at") - short + 1).cast("int")), "buckets")
    shelf.drop("met")
    wanted = shelf.put(buckets.select("doc_id").distinct(), "wanted")
    known_facts = shelf.put(facts.join(if_small(wanted), "doc_id", "left_semi").select("doc_id", "n", "parity"), "known")
    shelf.drop("facts")

    join = _Join(shelf, buckets, known_facts, rows, single)
    apart = None
    for turn in range(MOST_ROUNDS):
        placed = shelf.put(join.placed(), f"placed{turn}")
        size = placed.groupBy("token", "component").count().groupBy("token").agg(
            F.sum("count").alias("all"), F.sum(F.col("count") * F.col("count")).alias("same")).agg(
            F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.sum("all")).first()
        # A round that spares fewer pairs than it reads rows costs more than it saves; the last step compares what is left.
        before, apart = apart, size[0] or 0
        if turn and (apart <= 4 * (size[1] or 0) or turn > 1 and before - apart < size[1]):
            shelf.drop(f"placed{turn}")
            break
        # The first leader is the document with the fewest rare shingles, often what others were copied
        # from; later ones are drawn by hash.  Either is mostly the same one in all buckets that documents share.
        rank = F.col("rare").cast("long") if turn == 0 else F.xxhash64("component", F.lit(turn))
        leader = placed.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "doc_id", "n", "at", "component")).alias("l")).select(
            "token", "l.*")
        star = placed.alias("x").join(leader.alias("y"), "token").filter(
            (F.col("x.component") != F.col("y.component")) & _possible("x", "y"))
        pairs = star.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
        more = join.add(join.verified(pairs))
        shelf.drop(f"placed{turn}")
        if turn and not more:
            break

    # Every pair that is left: different components, and enough shared in the prefixes of the shorter match.
    placed = shelf.put(join.placed().join(if_small(known_facts.select("doc_id", "parity"), 100_000), "doc_id"), "placed")
    met = placed.alias("x").join(placed.alias("y"), "token").filter(
        (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & _possible("x", "y")
        & _alike("x.parity", "y.parity", F.col("x.n"), F.col("y.n")))
    needed = F.least("x.matches", "y.matches")
    pairs = (met.filter(F.greatest("x.level", "y.level") <= needed)
             .groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(
                 F.count("*").alias("shared"), F.first(needed).alias("needed")).filter("shared >= needed").select("a", "b"))
    join.add(join.verified(pairs))
    shelf.drop("placed", "buckets", "wanted", "known")

    joined = join.component
    if joined is None:
        joined = first.limit(0).withColumn("component", F.col("doc_id"))
    moved = joined.filter("doc_id <> component").select(F.col("doc_id").alias("first"), "component")
    twins = groups.filter("first < last").select("n", "sign", "first")
    return (signs.join(if_small(twins), ["n", "sign"], "left")
            .withColumn("first", F.coalesce("first", "doc_id")).join(if_small(moved), "first", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first")).alias("component_id")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component, with all columns; texts without words and rows
    without id stay.  Of rows repeated under one id all stay or none."""
    own = unused("__id", docs)
    away = Shelf(docs.sparkSession).put(
        components(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct(), "away")
    return docs.join(if_small(away), docs["doc_id"] == F.col(own), "left_anti")


OP7_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents),
    s AS (
        SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
               ELSE list_distinct(list_transform(range(1, len(words) - 3),
                                                 lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
        FROM w),
    g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
    shared AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
          FROM g a JOIN shared USING (gram) JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
          WHERE 100 * common >= 80 * (len(x.grams) + len(y.grams) - common)),
    reach AS (SELECT doc_id, doc_id AS low FROM s
              UNION SELECT l.b, reach.low FROM reach JOIN l ON l.a = reach.doc_id)
    SELECT s.doc_id, CAST(len(grams) AS bigint) AS n_shingles, min(low) AS component_id
    FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, grams"""
