"""MinHash near duplicates by an inverted join over signature coordinates.

1. Every distinct set of word shingles gets a signature of COORDINATES minima.  A posting is a pair of coordinate and value;
   two sets collide in about as many coordinates as their Jaccard similarity says.
2. Prefix merging.  Postings are ordered by how many sets hold them, the rare ones first.  Sets that collide in MATCHES
   coordinates share one of the first COORDINATES - MATCHES + 1 postings of each, so only these are
   merged.  The longest lists, MATCHES - 1 of every set, are skipped: their collisions are counted from the
   signatures of the pairs that the merged lists bring together.
3. Pairs with at least MATCHES collisions are retained, and confirmed on the full sets.  Rounds of stars, in which every
   list meets one leader, join the groups first, so a group of near copies costs rows in proportion to its size; then
   all retained pairs of sets that are still in different components are confirmed.

A pair that links with similarity s is missed only if fewer than MATCHES of its coordinates collide: for 0.85 and 36 of 64 once in
some 4 million such pairs, for 0.9 once in 10^10, and a document is lost only if all its links are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import Shelf, if_small, slices, small_batches, table
from gaugeline.llm.ngram_join import PARITY_LONGS, distinct, merged, parities, shingle_sets, shingles_of
from gaugeline.llm.subword import mixed

GRAM = 3
PERCENT = 85
COORDINATES = 64
MATCHES = 36
PREFIX = COORDINATES - MATCHES + 1
#: Postings that get a frequency class: the most frequent ones, at most so many (9 bytes each).
KNOWN = 1 << 18
LEAST_COUNT = 4
SKETCH_LONGS = COORDINATES // 16
MOST_ROUNDS = 6
#: Rows of some 350 bytes, and of a whole set, that may be broadcast; texts and pairs of sets a task holds at a time.
TRAIT_ROWS, SET_ROWS = 50_000, 1_000
TEXT_ROWS, PAIR_ROWS = 1_000, 256
U = np.uint64
_FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """COORDINATES values of 32 bits per set; those of an empty set are 0."""
    made = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[full]
        for k, factor in enumerate(_FACTORS):
            lowest = np.minimum.reduceat(flat * factor, starts)
            made[full, k] = mixed(lowest) >> U(32)
    return made


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    ends = np.arange(len(rows) + 1) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, sign (two hashes of the set), coordinates, parity of every row of (doc_id, text)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                flat, bounds = distinct(*shingles_of(part.column("text"), GRAM))
                sums = [np.append(U(0), np.cumsum(mixed(flat + U(k)), dtype=U)) for k in (0, 77)]
                signs = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], 1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds)), _lists(signs),
                     _lists(signatures(flat, bounds).view(np.int32)), _lists(parities(flat, bounds))],
                    ["doc_id", "n", "sign", "coordinates", "parity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(make, f"doc_id {kind}, n long, sign array<bigint>, coordinates array<int>, parity array<bigint>")


def _postings(values: np.ndarray) -> np.ndarray:
    """58-bit names of the coordinate-value pairs of a signature matrix."""
    at = np.arange(COORDINATES, dtype=U) << U(32)
    return mixed(at | values.astype(U)) >> U(6)


def frequent(sets: DataFrame, most: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent postings ascending by name, and floor(log2(sets that hold them)).

    All postings are counted.  The list is cut at a class, so that at most `most` reach the driver.
    """
    shelf = Shelf(sets.sparkSession)
    counted = shelf.put(
        sets.select(F.posexplode("coordinates").alias("at", "value")).groupBy("at", "value").count()
        .filter(F.col("count") >= LEAST_COUNT)
        .select("at", "value", F.floor(F.log2("count")).cast("int").alias("level")), "counted")
    per_level = {r["level"]: r["count"] for r in counted.groupBy("level").count().collect()}
    least, held = 64, 0
    while least and held + per_level.get(least - 1, 0) <= most:
        least -= 1
        held += per_level.get(least, 0)
    kept = counted.filter(F.col("level") >= least).toArrow()
    shelf.drop("counted")
    at, value, level = (kept[c].to_numpy().astype(np.int64) for c in ("at", "value", "level"))
    names = mixed((at.astype(U) << U(32)) | (value & 0xFFFFFFFF).astype(U)) >> U(6)
    order = np.argsort(names)
    return names[order], level[order].astype(np.uint8)


def prefixes(sets: DataFrame, known) -> DataFrame:
    """doc_id, n, rare (postings without a class), prefix, sketch (4 bits of every coordinate).  known: the broadcast list."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, levels = known.value
        for batch in batches:
            values = batch.column("coordinates").flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(-1, COORDINATES)
            tokens = _postings(values)
            level = np.zeros(tokens.shape, U)
            if len(names):
                at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
                level = np.where(names[at] == tokens, levels[at], 0).astype(U)
            ordered = np.sort((level << U(58)) | tokens, axis=1)[:, :PREFIX]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n"), pa.array((level == 0).sum(1), pa.int32()),
                 _lists(ordered.view(np.int64)), _lists(sketches(values))],
                ["doc_id", "n", "rare", "prefix", "sketch"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    return sets.select("doc_id", "n", "coordinates").mapInArrow(
        make, f"doc_id {kind}, n long, rare int, prefix array<bigint>, sketch array<bigint>")


def sketches(values: np.ndarray) -> np.ndarray:
    """The lowest 4 bits of all coordinates, 16 of them in a long."""
    low = (values & np.uint32(15)).astype(np.uint8)
    return np.ascontiguousarray(low[:, ::2] | low[:, 1::2] << 4).view(np.int64)


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the ascending shingles as bytes."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), GRAM)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return docs.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set binary")


def confirmed(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sa, sb) of which 100 * intersection >= 85 * union."""
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


def agreeing(a: Column, b: Column) -> Column:
    """Coordinates whose 4 bits agree in two sketches: all that collide, and one in 16 of the others."""
    def zero_nibbles(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for step in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        return F.lit(16) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return sum((zero_nibbles(k) for k in range(1, SKETCH_LONGS)), zero_nibbles(0))


def collisions(a: Column, b: Column) -> Column:
    """Coordinates that two signatures have in common."""
    same = [(F.get(a, F.lit(k)) == F.get(b, F.lit(k))).cast("int") for k in range(COORDINATES)]
    return sum(same[1:], same[0])


def _promising(x: str, y: str) -> Column:
    """What two rows of one list must have to collide in MATCHES coordinates and to link; no pair that does is refused."""
    (n, a), (m, b) = ((F.col(f"{s}.n"), F.col(f"{s}.sketch")) for s in (x, y))
    return (n * PERCENT <= m * 100) & (m * PERCENT <= n * 100) & (agreeing(a, b) >= MATCHES)


def _parity_allows(n: Column, m: Column, a: Column, b: Column) -> Column:
    """Sets that link differ in at most n + m - 2 * overlap shingles, so in no more bits of their parities."""
    needed = F.ceil(F.lit(PERCENT) * (n + m) / F.lit(100 + PERCENT)).cast("long")
    differing = sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PARITY_LONGS)), F.lit(0))
    return differing <= n + m - 2 * needed


def _retained(x: str, y: str) -> Column:
    """MATCHES collisions, and parities with which two sets can link."""
    a, b = ({f: F.col(f"{s}.{f}") for f in ("n", "coordinates", "parity")} for s in (x, y))
    return ((collisions(a["coordinates"], b["coordinates"]) >= MATCHES)
            & _parity_allows(a["n"], b["n"], a["parity"], b["parity"]))


class _Merge:
    """The merge of posting lists: rows (doc_id, token, rare, n, sketch), traits (doc_id, n, coordinates, parity) and
    texts by doc_id, and the components so far."""

    def __init__(self, shelf: Shelf, rows: DataFrame, traits: DataFrame, sets_of: Callable[[DataFrame], DataFrame]):
        self.shelf, self.rows, self.traits, self.sets_of = shelf, rows, traits, sets_of
        self.component, self.step = None, 0

    def placed(self) -> DataFrame:
        """Rows with their component."""
        if self.component is None:
            return self.rows.withColumn("component", F.col("doc_id"))
        return self.rows.join(if_small(self.component), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id"))

    def confirm(self, met: DataFrame) -> bool:
        """Add the pairs (a, b) of `met` that are retained and link; says whether there were any."""
        self.step += 1
        pairs = self.shelf.put(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"met{self.step}")
        ends = self.shelf.put(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"ends{self.step}")
        own = self.shelf.put(self.traits.join(if_small(ends), "doc_id", "left_semi"), f"traits{self.step}")
        x, y = (if_small(own.select(F.col("doc_id").alias(s), F.struct("n", "coordinates", "parity").alias(f"t{s}")), TRAIT_ROWS)
                for s in "ab")
        near = self.shelf.put(pairs.join(x, "a").join(y, "b").filter(_retained("ta", "tb")).select("a", "b"), f"near{self.step}")
        ends = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = self.shelf.put(self.sets_of(ends), f"sets{self.step}")
        x, y = (if_small(sets.select(F.col("doc_id").alias(s), F.col("set").alias(f"s{s}")), SET_ROWS) for s in "ab")
        with small_batches(near.sparkSession, PAIR_ROWS):
            more = self.shelf.put(confirmed(near.join(x, "a").join(y, "b")), f"links{self.step}")
        self.shelf.drop(*[f"{name}{self.step}" for name in ("met", "ends", "traits", "near", "sets")])
        if more.isEmpty():
            return False
        self.component = self.shelf.put(merged(self.component, more), f"component{self.step}")
        self.shelf.drop(f"component{self.step - 1}", f"links{self.step}")
        return True

    def run(self) -> DataFrame | None:
        """(doc_id, component) of all linked sets."""
        before = None
        for turn in range(MOST_ROUNDS + 1):
            placed = self.placed()
            # The first leader is the set whose postings are the commonest, often what others were copied from;
            # later ones are drawn by hash.  Either is mostly the same one in all lists that sets share.
            rank = F.col("rare").cast("long") if turn == 0 else F.xxhash64("component", F.lit(turn))
            lists = placed.groupBy("token").agg(
                F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y"),
                F.min(F.struct(rank.alias("rank"), "doc_id", "component", "n", "sketch")).alias("leader"))
            lists = self.shelf.put(lists.filter("x < y").select("token", "m", "leader"), f"lists{turn}")
            pairs, rows = lists.agg(F.sum(F.col("m") * F.col("m")), F.sum("m")).first()
            # Stars go on while they make the lists smaller and many pairs would be left without them.
            if turn == MOST_ROUNDS or (pairs or 0) <= 4 * (rows or 0) or (before and pairs > 0.8 * before):
                break
            before = pairs
            star = placed.alias("own").join(lists.select("token", "leader"), "token").filter(
                (F.col("own.component") != F.col("leader.component")) & _promising("own", "leader"))
            more = self.confirm(star.select(F.col("own.doc_id").alias("a"), F.col("leader.doc_id").alias("b")))
            self.shelf.drop(f"lists{turn}")
            if not more:
                lists = None
                break
        # What is left: every two sets of one list in different components.
        rest = self.placed().drop("rare")
        if lists is not None:
            rest = rest.join(lists.select("token"), "token", "left_semi")
        ids = self.shelf.put(rest.select("doc_id").distinct(), "ids")
        parity = self.shelf.put(self.traits.join(if_small(ids), "doc_id", "left_semi").select("doc_id", "parity"), "parity")
        rest = self.shelf.put(rest.join(if_small(parity, 2 * TRAIT_ROWS), "doc_id"), "rest")
        met = rest.alias("x").join(rest.alias("y"), "token").filter(
            (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & _promising("x", "y")
            & _parity_allows(*[F.col(c) for c in ("x.n", "y.n", "x.parity", "y.parity")]))
        self.confirm(met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")))
        self.shelf.drop("rest", "ids", "parity")
        return self.component


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Documents link when their sets of distinct 3-word shingles have a Jaccard similarity of 0.85 or more; component_id is the
    smallest id that links reach.  Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of one or two words has one
    shingle, the whole of it.  Null or empty texts have none and link with nothing.  Repeated rows come out
    repeated; of different texts under one id the one with the least shingles (then the least hash) stands for
    the id, and all its rows get its component.  A null id gets a null component and links nothing.  Other
    columns are not read.  An empty table gives no rows.  Shingles are compared by 64-bit hashes.
    """
    with small_batches(docs.sparkSession, TEXT_ROWS):
        return _components(docs, id_col, text_col, known)


def _components(docs: DataFrame, id_col: str, text_col: str, known: int) -> DataFrame:
    spark = docs.sparkSession
    shelf = Shelf(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = shelf.put(signed(rows), "signed")
    real = made.filter("n > 0 and doc_id is not null")
    repeated = not real.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeated:
        real = shelf.put(real.groupBy("doc_id").agg(F.min(F.struct("n", "sign", "coordinates", "parity")).alias("s")).select(
            "doc_id", "s.*"), "one-per-id")

    # One document stands for all with the same set.
    twins = shelf.put(real.groupBy("n", "sign").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                      .filter("first < last").drop("last"), "twins")
    sets = real.join(if_small(twins), ["n", "sign"], "left").filter("first is null or first = doc_id")
    shared = spark.sparkContext.broadcast(frequent(sets, known))
    headed = shelf.put(prefixes(sets, shared), "prefixes")
    shared.destroy()

    # Rows of the lists that hold two sets or more.
    every = headed.select("doc_id", "rare", "n", "sketch", F.explode("prefix").alias("token"))
    live = every.groupBy("token").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("token")
    lists = shelf.put(every.join(live, "token", "left_semi"), "rows")
    shelf.drop("prefixes")

    def sets_of(ids: DataFrame) -> DataFrame:
        """The full sets of some documents; of texts under one id the one that stands for it."""
        found = full_sets(rows.join(if_small(ids), "doc_id", "left_semi"))
        if not repeated:
            return found
        found = found.join(real.select("doc_id", "n"), "doc_id").filter(F.octet_length("set") == 8 * F.col("n"))
        return found.groupBy("doc_id").agg(F.min("set").alias("set"))

    joined = _Merge(shelf, lists, real.select("doc_id", "n", "coordinates", "parity"), sets_of).run()
    shelf.drop("rows")
    own = (real if repeated else made).select("doc_id", "n", "sign").join(if_small(twins), ["n", "sign"], "left").withColumn(
        "first", F.coalesce("first", "doc_id"))
    component = F.col("first")
    if joined is not None:
        moved = joined.filter("doc_id <> component").select(F.col("doc_id").alias("first"), "component")
        own, component = own.join(if_small(moved), "first", "left"), F.coalesce("component", "first")
    own = own.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    if repeated:
        own = made.select("doc_id", "n").join(own.drop("n"), "doc_id", "left").withColumn(
            "component_id", F.coalesce("component_id", "doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP13_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents),
    s AS (
        SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
               ELSE list_distinct(list_transform(range(1, len(words) - 1),
                                                 lambda i: array_to_string(words[i:i + 2], ' '))) END AS grams
        FROM w),
    g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
    shared AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
          FROM g a JOIN shared USING (gram) JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
          WHERE 100 * common >= 85 * (len(x.grams) + len(y.grams) - common)),
    reach AS (SELECT doc_id, doc_id AS low FROM s
              UNION SELECT l.b, reach.low FROM reach JOIN l ON l.a = reach.doc_id)
    SELECT s.doc_id, CAST(len(grams) AS bigint) AS n_shingles, min(low) AS component_id, s.doc_id = min(low) AS kept
    FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, grams"""
