"""Merkle manifest of a dataset: one tree per part and one over the parts, with a proof for every row.

Built by time-forward processing.  Nodes are labelled by (level, index), so every label is smaller than its parent's.  A
priority queue in order of labels holds the messages that wait for their addressee: on the way up a node takes
its children's digests from the queue and posts its own to its parent; on the way down, in the reversed order, it takes the
rest of its proof and posts the longer one to each child.

The queue is external.  Between blocks of BLOCK_LEVELS levels (ARITY ** BLOCK_LEVELS nodes at the bottom) messages wait in Spark's
sorted shuffle under the label of the block they are for; inside a block they wait in a heap, which so never holds
more than one block.  Every sweep over blocks is a stored table, so a lost executor costs some blocks only.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gaugeline.llm.common import LOWER, UPPER, Shelf, ascii_lower, if_small, table
from gaugeline.plans.groups import attach

ARITY = 8
BLOCK_LEVELS = 4
_CHAIN = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_CHAIN_SQL = "array<struct<left:string,right:string>>"
Runs = dict[tuple[int, int], list[str]]


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(leaves: list[str], levels: int) -> tuple[Runs, str]:
    """The children's digests of every node above `leaves`, and the digest of the node `levels` above them."""
    runs: Runs = {}
    digest = leaves[0]
    queue = [(1, i // ARITY, i, d) for i, d in enumerate(leaves)] if levels else []  # sorted, so a heap
    while queue:
        label = queue[0][:2]
        run = runs[label] = []
        while queue and queue[0][:2] == label:
            run.append(heappop(queue)[3])
        digest = digest_of("".join(run))
        if label[0] < levels:
            heappush(queue, (label[0] + 1, label[1] // ARITY, label[1], digest))
    return runs, digest


def descend(runs: Runs, levels: int, rest: tuple) -> list[tuple]:
    """The proof of every leaf: pairs of the digests left and right of the path, level by level, then `rest`."""
    if not levels:
        return [rest]
    proofs = []
    queue = [(-levels, 0, rest)]
    while queue:
        level, index, chain = heappop(queue)
        run = runs[-level, -index]
        for slot in reversed(range(len(run))):
            longer = (("".join(run[:slot]), "".join(run[slot + 1:])), *chain)
            if level == -1:
                proofs.append(longer)
            else:
                heappush(queue, (level + 1, index * ARITY - slot, longer))
    return proofs[::-1]  # the queue gave the last leaf first


def _chains(proofs: list[tuple]) -> pa.Array:
    ends = [0]
    for chain in proofs:
        ends.append(ends[-1] + len(chain))
    sides = [pa.array([pair[k] for chain in proofs for pair in chain], pa.string()) for k in (0, 1)]
    pairs = pa.StructArray.from_arrays(sides, fields=list(_CHAIN.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, type=_CHAIN)


class Forest:
    """Trees over nodes (tree, pos, height, digest, row): pos counts from 0 in a tree; row is what a leaf carries."""

    def __init__(self, shelf: Shelf, name: str, nodes: DataFrame):
        self.shelf, self.name, self.levels = shelf, name, [nodes]
        highest = nodes.agg(F.max("height")).first()[0] or 0
        self.rounds = max(1, -(-highest // BLOCK_LEVELS))

    def _blocks(self, turn: int) -> DataFrame:
        """Nodes of one round with their block and the levels it is high."""
        left = F.col("height") - BLOCK_LEVELS * turn
        return self.levels[turn].withColumns({
            "block": F.floor(F.col("pos") / ARITY**BLOCK_LEVELS).cast("long"),
            "up": F.greatest(F.lit(0), F.least(F.lit(BLOCK_LEVELS), left)).cast("int")})

    def up(self) -> DataFrame:
        """(tree, digest) of every tree's top."""
        def block(nodes: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("pos")
            top = climb(nodes["digest"].to_pylist(), nodes["up"][0].as_py())[1]
            return nodes.slice(0, 1).select(["tree", "block", "height"]).append_column("digest", pa.array([top]))

        for turn in range(self.rounds):
            tops = self._blocks(turn).select("tree", "pos", "height", "digest", "block", "up").groupBy("tree", "block").applyInArrow(
                block, "tree long, block long, height int, digest string")
            self.levels.append(self.shelf.put(tops.withColumnRenamed("block", "pos"), f"{self.name}{turn}"))
        return self.levels[-1].select("tree", "digest")

    def down(self, rests: DataFrame) -> DataFrame:
        """row, subroot, root and proof of every leaf; rests (tree, subroot, root, proof): what follows the tree's top."""
        def block(nodes: pa.Table, rest: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("pos")
            levels = nodes["up"][0].as_py()
            chain = tuple((pair["left"], pair["right"]) for pair in rest["proof"][0].as_py())
            proofs = descend(climb(nodes["digest"].to_pylist(), levels)[0], levels, chain)
            kept = nodes.select([c for c in ("tree", "pos", "row") if c in nodes.column_names])
            for name in ("subroot", "root"):
                kept = kept.append_column(name, pa.array([rest[name][0].as_py()] * len(proofs), pa.string()))
            return kept.append_column("proof", _chains(proofs))

        rests = rests.withColumn("pos", F.lit(0).cast("long"))
        for turn in reversed(range(self.rounds)):
            nodes = self._blocks(turn)
            kept = [f for f in nodes.schema.fields if f.name in ("tree", "pos", "row")]
            made = StructType([*kept, *StructType.fromDDL(f"subroot string, root string, proof {_CHAIN_SQL}").fields])
            rests = nodes.groupBy("tree", "block").cogroup(rests.groupBy("tree", "pos")).applyInArrow(block, made)
            if turn:
                rests = self.shelf.put(rests, f"{self.name}{turn}-rests")
                self.shelf.drop(f"{self.name}{turn}")
        return rests


def _height(leaves: Column) -> Column:
    """Levels above so many leaves until one node is left."""
    return sum(((leaves > ARITY**level).cast("int") for level in range(21)), F.lit(0))


def _sorted(shelf: Shelf, name: str, rows: DataFrame, part: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a stored table in ranges of (part, order), and per part and range what must be added to `seq` for a row's place.

    Equal rows are divided between ranges by where they are stored.  Only one row per part and range is ever ordered
    in a window.
    """
    by = [*part, *order, "salt"]
    ranged = (rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
              .select(*rows.columns, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("seq")))
    ranged = shelf.put(ranged, name)
    sizes = ranged.groupBy(*part, "range").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    earlier = Window.partitionBy(*part).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, sizes.select(*part, "range", "n", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("add"))


def manifest(leaves: DataFrame, part: str, order: list[str], digest: str) -> DataFrame:
    """The rows of `leaves` with subroot, root and proof.

    A part's leaves ascend by `order`, nulls first, equal ones by digest.  While there is more than one node, every ARITY
    consecutive ones become the hash of their digests.  The parts' tops, ordered by part (null first, bytes of UTF-8), make one
    more tree in the same way.  subroot is the part's top, root that of all; proof is the list of what stands left and
    right of the path from the leaf to the root, so folding it over the leaf gives the root.

    leaves: any columns; `digest` is hexadecimal text and not null.  Columns called subroot, root or proof are replaced.
    Null parts are a part of their own, null order values come first; repeated rows are leaves each.  An empty
    table gives no rows.
    """
    shelf = Shelf(leaves.sparkSession)
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    keys = [f"k{i}" for i in range(len(order))]
    # The caller's columns travel in one struct, so that no name can clash.
    rows = shelf.put(leaves.select(
        F.col(part).alias("part"), *[F.col(c).alias(k) for c, k in zip(order, keys)], F.col(digest).alias("digest"),
        F.struct(*kept).alias("row")), "leaves")
    ranged, places = _sorted(shelf, "ranged", rows, ["part"], [*keys, "digest"])
    shelf.drop("leaves")
    places = shelf.put(places, "places")
    parts = shelf.put(places.groupBy("part").agg(F.sum("n").alias("leaves")), "parts")
    by_part, starts = _sorted(shelf, "by-part", parts, [], ["part"])
    trees = shelf.put(by_part.join(F.broadcast(starts), "range").select(
        "part", (F.col("seq") + F.col("add")).alias("tree"), _height(F.col("leaves")).alias("height")), "trees")
    where = shelf.put(attach(places.select("part", "range", "add"), trees, ["part"]), "where")
    nodes = attach(ranged.select("part", "range", "seq", "digest", "row"), if_small(where), ["part", "range"]).select(
        "tree", (F.col("seq") + F.col("add")).alias("pos"), "height", "digest", "row")

    low = Forest(shelf, "low", nodes)
    subroots = low.up()
    count = trees.agg(_height(F.count("*")).alias("height")).scalar()
    high = Forest(shelf, "high", shelf.put(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), count.alias("height"), "digest",
        F.struct("tree", F.col("digest").alias("subroot")).alias("row")), "subroots"))
    root = high.up().select("tree", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
                            F.array().cast(_CHAIN_SQL).alias("proof"))
    rests = shelf.put(high.down(root).select("row.tree", "row.subroot", "root", "proof"), "rests")
    return low.down(rests).select("row.*", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda d, side: F.sha2(F.concat(side["left"], d, side["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda side: F.concat(side["left"], side["right"])), "")


def row_digest(*values: Column) -> Column:
    """SHA-256 of the values one after the other, each as its length in bytes, a colon and its text; null is `-`."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def op11_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as leaves, a tree per language, and what the proofs say of rows that were tampered with."""
    c = {name: F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.pmod(F.crc32(c["doc_id"].cast("string")), F.lit(3)) == 0
    lower = F.when(c["text"].isNotNull(), ascii_lower(c["text"]))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", row_digest(*c.values()).alias("leaf"),
        F.when(tampered, row_digest(*[c[n] for n in list(c)[:-1]], lower)).alias("changed"))
    proven = manifest(docs, "lang", ["doc_id"], "leaf")
    end = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    return proven.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        end.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, first: str, rows: str, levels: int) -> str:
    """Trees over `first` (tree, pos, digest) as {name}_n0.., and the paths of `rows` (tree, pos, proof, fold, *) as {name}_c0..."""
    parts = [f"{name}_n0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {first})"]
    for level in range(levels):
        parts.append(f"""{name}_r{level} AS (
            SELECT tree, pos // 8 AS pos, list(digest ORDER BY pos) AS ds, any_value(m) AS m FROM {name}_n{level} GROUP BY tree, pos // 8)""")
        parts.append(f"""{name}_n{level + 1} AS (
            SELECT tree, pos, CASE WHEN m = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest,
                   count(*) OVER (PARTITION BY tree) AS m FROM {name}_r{level})""")
    parts.append(f"{name}_c0 AS (SELECT * FROM {rows})")
    for level in range(levels):
        left, right = "array_to_string(ds[1:c.pos % 8], '')", "array_to_string(ds[c.pos % 8 + 2:], '')"
        parts.append(f"""{name}_c{level + 1} AS (
            SELECT c.* REPLACE (c.pos // 8 AS pos,
                   CASE WHEN m = 1 THEN proof ELSE concat(proof, {left}, {right}) END AS proof,
                   CASE WHEN m = 1 THEN fold ELSE sha256(concat({left}, fold, {right})) END AS fold)
            FROM {name}_c{level} c JOIN {name}_r{level} r ON r.tree = c.tree AND r.pos = c.pos // 8)""")
    return ",\n".join(parts)


def _row_sql(text: str) -> str:
    values = [f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen({v}::varchar), ':', {v}) END"
              for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256(concat({', '.join(values)}))"


# Up to 8 ** 8 documents of a language; CRC-32 bit by bit over the id's digits (-1 marks the shift of a bit).
OP11_SQL = f"""
    WITH d AS (
        SELECT doc_id, lang, {_row_sql('text')} AS leaf, {_row_sql(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed,
               xor(4294967295, list_reduce(
                   list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''),
                       lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))
                   % 3 = 0 AS tampered
        FROM documents),
    langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM d)),
    leaves AS (
        SELECT doc_id, leaf, coalesce(tampered, false) AS tampered, changed, tree,
               row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM d JOIN langs ON langs.lang IS NOT DISTINCT FROM d.lang),
    firsts AS (SELECT tree, pos, leaf AS digest FROM leaves),
    paths AS (SELECT doc_id, leaf, tree, pos, '' AS proof, CASE WHEN tampered THEN changed ELSE leaf END AS fold FROM leaves),
    {_levels_sql('low', 'firsts', 'paths', 8)},
    subroots AS (SELECT 0 AS tree, tree AS pos, digest FROM low_n8),
    links AS (SELECT doc_id, leaf, digest AS subroot, 0 AS tree, c.tree AS pos, proof, fold
              FROM low_c8 c JOIN low_n8 n ON n.tree = c.tree),
    {_levels_sql('high', 'subroots', 'links', 3)}
    SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = digest AS verified
    FROM high_c3, high_n3"""
