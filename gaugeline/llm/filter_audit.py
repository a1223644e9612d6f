"""Filter interaction audit: what every order of a set of filters removes, from paths through the subset lattice.

A state of the lattice is the set of filters that have run, and an edge leads from a state to one with one filter more.
A document takes part only by the set of filters it fails, so rows are counted once per set of
failures and everything else is read from those counts: the edge (state, filter) removes the documents that
fail the filter and none of the state.  A step of an order is one edge.  The orders that use an edge are the paths that
reach its state times the paths that leave its end; with them as weights the removals of a filter's
edges add up to its removals over all orders, which is Shapley's sum.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import UPPER, Shelf, if_small, table

#: Every order is a row of the report, so the number of filters is small.
MOST_FILTERS = 7
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def paths(n: int) -> list[tuple[int, int, int]]:
    """Edges (state, filter, orders that use it) of the lattice over n filters; a state is a bit mask.

    Forward: the orders that reach a state are those of the states one filter below it.  Backward: those that leave it are
    those of the states one filter above it.
    """
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(1, full + 1):  # a state's subsets have smaller numbers
        reach[state] = sum(reach[state ^ 1 << f] for f in range(n) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        leave[state] = sum(leave[state | 1 << f] for f in range(n) if not state >> f & 1)
    return [(state, f, reach[state] * leave[state | 1 << f])
            for state in range(full + 1) for f in range(n) if not state >> f & 1]


def steps(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, state before it, filter) of every order of the filters."""
    found = []
    for order in permutations(range(len(names))):
        state = 0
        for at, f in enumerate(order):
            found.append(("".join(names[g] for g in order), at + 1, state, f))
            state |= 1 << f
    return found


def audit(marked: DataFrame, names: list[str]) -> DataFrame:
    """Per part, filter_order and step: the MEASURES of that step and the `shapley` sum of its filter.

    marked: part (string), fails (bit i is set where a row fails names[i]), good and toxic (boolean).  Every part that
    occurs gets all orders and steps, zeros included; a null part is the empty string's.  Null
    fails count as none, null good or toxic as false.  Repeated rows count one each; other columns are not
    read; an empty table gives no rows.  Rows are added up map-side to at most 2^n per part, so no part
    is bound to one task.
    """
    n = len(names)
    if not 0 < n <= MOST_FILTERS or len(set(names)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} filters of different names are needed")
    session = marked.sparkSession
    cells = marked.groupBy(
        F.coalesce("part", F.lit("")).alias("part"), F.coalesce(F.col("fails").cast("int"), F.lit(0)).alias("fails")).agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    lattice = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders"))
                        for s, f, w in paths(n)])
    at = cells.select("*", F.inline(lattice))
    bit = F.expr("shiftleft(1, filter)")
    before = F.col("fails").bitwiseAND(F.col("state")) == 0  # fails none of the filters that have run
    here = F.col("fails").bitwiseAND(bit) != 0

    def where(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    edges = at.groupBy("part", "state", "filter", "orders").agg(
        where(before & ~here).alias("kept"), where(before & here).alias("removed"),
        where(~before & here).alias("redundant"), where(F.col("fails") == bit).alias("unique_fails"),
        where(before & here, "good").alias("good_lost"), where(before & here, "toxic").alias("toxic_lost"))
    sums = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    plan = session.createDataFrame(steps(names), "filter_order string, step int, state int, filter int")
    return (edges.join(F.broadcast(plan), ["state", "filter"]).join(sums, ["part", "filter"])
            .select("part", "filter_order", "step", *MEASURES, "shapley"))


def failures(conditions: Mapping[str, Column]) -> Column:
    """Bit i is set where the i-th condition is true; null is not a failure."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions.values())]
    return sum(bits[1:], bits[0])


def text_conditions(text: Column) -> dict[str, Column]:
    """What is wrong with a text by itself; null is an empty text, which fails A only.

    A: under 100 words.  B: fewer than 80 % distinct words.  C: over 10 % capitals A-Z.
    D: holds one of #$%&*|.  Words are `[^\\x20\\x09-\\x0D]+`.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def marked_documents(docs: DataFrame, labels: DataFrame, part_col: str = "lang",
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: part, fails (over A to E), good, toxic, ready for `audit`.

    E: the text is that of a row with a smaller id anywhere in the table; SHA-256 stands for the text, null is
    empty.  Rows with the smallest id, all of them where it is repeated, do not fail, nor does a null id, which is
    smaller than none.  good and toxic: `labels` (doc_id, quality, toxic) has a row of this id with quality,
    or toxic, of 1; of several rows any counts.  Null ids have no labels.
    """
    shelf = Shelf(docs.sparkSession)
    text = F.col(text_col)
    alone = text_conditions(text)
    rows = shelf.put(docs.select(
        F.col(id_col).alias("doc_id"), F.col(part_col).cast("string").alias("part"), failures(alone).alias("alone"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("sha")), "failures")
    # Digests that occur under one id only cannot fail; the others are few unless copies abound.
    repeated = shelf.put(rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                         .filter("first < last").select("sha", "first"), "repeated")
    known = shelf.put(labels.groupBy(F.col("doc_id").alias("__of")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).filter("good or toxic"), "known")
    joined = (rows.join(if_small(repeated), "sha", "left")
              .join(if_small(known), F.col("doc_id") == F.col("__of"), "left"))
    again = F.when(F.col("first") < F.col("doc_id"), F.lit(1 << len(alone))).otherwise(0)
    return joined.select("part", (F.col("alone") + again).alias("fails"), "good", "toxic")


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(marked_documents(docs, labels), list("ABCDE"))


OP12_SQL = rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
                        CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                        CASE WHEN 100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 10 * length(t)
                             THEN 'C' ELSE '' END,
                        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                        CASE WHEN d.doc_id > first THEN 'E' ELSE '' END) AS failed
          FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
    cells AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
    one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM one a, one b, one c, one d, one e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS ran
              FROM orders, (SELECT unnest(range(1, 6)) AS step)),
    report AS (
        SELECT part, filter_order, CAST(step AS int) AS step, filter,
               CAST(sum(CASE WHEN translate(failed, ran || filter, '') = failed THEN n ELSE 0 END) AS bigint) AS kept,
               CAST(sum(CASE WHEN translate(failed, ran, '') = failed AND contains(failed, filter) THEN n ELSE 0 END)
                    AS bigint) AS removed,
               CAST(sum(CASE WHEN translate(failed, ran, '') <> failed AND contains(failed, filter) THEN n ELSE 0 END)
                    AS bigint) AS redundant,
               CAST(sum(CASE WHEN failed = filter THEN n ELSE 0 END) AS bigint) AS unique_fails,
               CAST(sum(CASE WHEN translate(failed, ran, '') = failed AND contains(failed, filter) THEN good ELSE 0 END)
                    AS bigint) AS good_lost,
               CAST(sum(CASE WHEN translate(failed, ran, '') = failed AND contains(failed, filter) THEN toxic ELSE 0 END)
                    AS bigint) AS toxic_lost
        FROM cells, steps GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, filter) AS bigint) AS shapley FROM report"""
