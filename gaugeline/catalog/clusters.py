"""Neighbours, clusterings, their scores, and parameter search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.catalog.common import latest_time, rounded, scratch, text_times
from gaugeline.catalog.features import leaves
from gaugeline.catalog.registry import define, query
from gaugeline.functions import vectors as vec
from gaugeline.operators import clustering as cl, neighbors as nb, quality, search
from gaugeline.session import settle
from gaugeline.sources import fixtures as fx, tables, uploads

POINT = ["measure_point_id"]
EPS, MIN_POINTS = 100.0, 4
LINK_K = 3
PLANE_EPS, PLANE_MIN = 1.05, 4
VECTORS_K, LLOYD_ROUNDS = (2, 10), 50
KMEANS_ROUNDS = 100
VECTORS_EPS, VECTORS_MIN = 1.2, 4
BOOTSTRAPS = 10
MERGE_ROUNDS = 50

define("pts", """
    SELECT measure_point_id, event_id AS id, cents AS x, data_type FROM stream_rows""", "stream_rows")
define("dense", f"""
    SELECT *, count(*) OVER (PARTITION BY measure_point_id ORDER BY x
                             RANGE BETWEEN {EPS} PRECEDING AND {EPS} FOLLOWING) AS neighbors
    FROM pts""", "pts")
define("core_rows", f"""
    SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY measure_point_id ORDER BY x, id) <= {EPS} THEN 0 ELSE 1 END AS new
    FROM dense WHERE neighbors >= {MIN_POINTS}""", "dense")
define("core_parts", """
    SELECT measure_point_id, island, min(id) AS first_core, min(x) AS lo, max(x) AS hi
    FROM (SELECT *, sum(new) OVER (PARTITION BY measure_point_id ORDER BY x, id) AS island FROM core_rows)
    GROUP BY ALL""", "core_rows")
define("dbscan_raw", f"""
    SELECT p.measure_point_id, p.id, p.x, min(first_core) AS part
    FROM pts p LEFT JOIN core_parts c ON c.measure_point_id = p.measure_point_id
      AND p.x >= lo - {EPS} AND p.x <= hi + {EPS} GROUP BY ALL""", "pts", "core_parts")
define("dbscan_labels", """
    SELECT measure_point_id, id, x,
           CASE WHEN part IS NULL THEN 0 ELSE CAST(dense_rank() OVER (
             PARTITION BY measure_point_id, part IS NULL ORDER BY first_id) AS int) END AS label
    FROM (SELECT *, min(id) OVER (PARTITION BY measure_point_id, part) AS first_id FROM dbscan_raw)""",
       "dbscan_raw")
define("link_cuts", f"""
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY measure_point_id ORDER BY gap DESC, x) AS r FROM (
            SELECT measure_point_id, x, x - lag(x) OVER (PARTITION BY measure_point_id ORDER BY x) AS gap
            FROM (SELECT DISTINCT measure_point_id, x FROM pts)) WHERE gap IS NOT NULL)
    WHERE r < {LINK_K}""", "pts")
define("link_labels", """
    SELECT p.measure_point_id, p.id, p.x, CAST(count(c.x) AS int) AS label
    FROM pts p LEFT JOIN link_cuts c ON c.measure_point_id = p.measure_point_id AND c.x <= p.x
    GROUP BY ALL""", "pts", "link_cuts")
define("vectors", """
    SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings""")
define("long", """
    SELECT vec_id AS id, label, unnest(range(1, 65)) AS dim, CAST(unnest(embedding) AS double) AS x
    FROM embeddings""")
define("centers", """
    SELECT label, dim, avg(x) AS c, count(*) AS n FROM long GROUP BY ALL""", "long")
define("plane", "SELECT p_partkey AS id, CAST(p_size AS double) AS x, p_retailprice AS y FROM part")
define("placed_vectors", """
    SELECT l.id, l.label, any_value(v.f) AS f, sqrt(sum((l.x - c.c) * (l.x - c.c))) AS distance
    FROM long l JOIN centers c ON l.label = c.label AND l.dim = c.dim JOIN vectors v ON v.id = l.id
    GROUP BY l.id, l.label""", "long", "centers", "vectors")


def line(spark, sf_dir):
    """Readings as points on a line, in hundredths."""
    return fx.reading_stream(spark, sf_dir).select(
        "measure_point_id", "data_type", F.col("event_id").alias("id"), F.col("cents").alias("x"))


def plane(spark, sf_dir):
    """Parts by size and price, two numbers that are their features."""
    return uploads.table_source(fx.table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])


def dbscan_points(spark, sf_dir):
    return cl.dbscan_1d(line(spark, sf_dir), POINT, "x", EPS, MIN_POINTS)


def link_points(spark, sf_dir):
    return cl.single_link_1d(line(spark, sf_dir), POINT, "x", LINK_K)


# ---- neighbours ------------------------------------------------------------------------


@query("nearest_centroid", """
    SELECT id, label, round(d, 6) AS distance FROM (
        SELECT l.id, c.label, sqrt(sum((l.x - c.c) * (l.x - c.c))) AS d,
               row_number() OVER (PARTITION BY l.id ORDER BY sqrt(sum((l.x - c.c) * (l.x - c.c))), c.label) AS r
        FROM long l JOIN centers c USING (dim) GROUP BY l.id, c.label) WHERE r = 1""", ("centers",))
def nearest_centroid(spark, sf_dir):
    points = fx.features(spark, sf_dir)
    centers = cl.cluster_centroids(points, [], 64).select("label", "centroid")
    near = nb.nearest_centroid(points, centers)
    return rounded(near.select("id", "label", "distance"), "distance")


@query("eps_neighbors", f"""
    SELECT a.id, b.id AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance
    FROM plane a JOIN plane b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {PLANE_EPS}""",
       ("plane",))
def eps_neighbors(spark, sf_dir):
    return rounded(nb.eps_neighbors(plane(spark, sf_dir), PLANE_EPS, 2), "distance")


@query("eps_count_1d", "SELECT id, neighbors FROM dense", ("dense",))
def eps_count_1d(spark, sf_dir):
    points = line(spark, sf_dir)
    counts = nb.eps_counts(nb.distinct_values(points, POINT, "x"), POINT, EPS)
    return nb.attach(points, counts.select(*POINT, "x", "neighbors"), [*POINT, "x"], "inner").select(
        "id", "neighbors")


@query("centroid_pairs", """
    SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.c - b.c) * (a.c - b.c))), 6) AS distance
    FROM centers a JOIN centers b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL""", ("centers",))
def centroid_pairs(spark, sf_dir):
    centers = cl.cluster_centroids(fx.features(spark, sf_dir), [], 64)
    return rounded(nb.centroid_pairs(centers, []), "distance")


@query("farthest_pair", """
    WITH spots AS (SELECT gateway_code, data_type, leaf_id AS label, sum(ls) / sum(n) AS c FROM leaves GROUP BY ALL),
    ends AS (SELECT * FROM (
        SELECT a.gateway_code, a.data_type, a.label AS a, b.label AS b, a.c AS ca, b.c AS cb,
               row_number() OVER (PARTITION BY a.gateway_code, a.data_type ORDER BY abs(a.c - b.c) DESC, a.label, b.label) AS r
        FROM spots a JOIN spots b ON a.gateway_code = b.gateway_code AND a.data_type = b.data_type AND a.label < b.label)
        WHERE r = 1)
    SELECT s.gateway_code, s.data_type, s.label, round(s.c, 6) AS centroid,
           CASE WHEN abs(s.c - ca) <= abs(s.c - cb) THEN 0 ELSE 1 END AS side
    FROM spots s JOIN ends USING (gateway_code, data_type)""", ("leaves",))
def farthest_pair(spark, sf_dir):
    """Leaves of each gateway and type split by their two farthest centroids."""
    keys = ["gateway_code", "data_type"]
    spots = leaves(spark, sf_dir, keys).select(
        *keys, F.col("leaf_id").alias("label"), vec.divide(F.col("ls"), F.col("n")).alias("centroid"))
    return rounded(nb.bisect(spots, keys).withColumn("centroid", F.col("centroid")[0]), "centroid")


@query("knn_distance", """
    SELECT id, d AS knn FROM (
        SELECT a.id, abs(a.x - b.x) AS d,
               row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - b.x)) AS r
        FROM pts a JOIN pts b ON a.measure_point_id = b.measure_point_id AND a.id <> b.id) WHERE r = 5""",
       ("pts",))
def knn_distance(spark, sf_dir):
    return nb.knn_distance(line(spark, sf_dir), POINT, "x", 5).select("id", "knn")


@query("sorted_knn_curve", """
    SELECT measure_point_id, id, d AS knn,
           row_number() OVER (PARTITION BY measure_point_id ORDER BY d, id) - 1 AS rank FROM (
        SELECT a.measure_point_id, a.id, abs(a.x - b.x) AS d,
               row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - b.x)) AS r
        FROM pts a JOIN pts b ON a.measure_point_id = b.measure_point_id AND a.id <> b.id) WHERE r = 5""",
       ("pts",))
def sorted_knn_curve(spark, sf_dir):
    return search.sorted_knn_curve(line(spark, sf_dir), POINT, "x", 5)


define("plane_knn", """
    SELECT id, d AS knn FROM (
        SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (
                   PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS r
        FROM plane a JOIN plane b ON a.id <> b.id) WHERE r = 5""", "plane")


@query("knn_distance_vectors", "SELECT id, round(knn, 9) AS knn FROM plane_knn", ("plane_knn",))
def knn_distance_vectors(spark, sf_dir):
    return rounded(nb.knn_distance_vectors(plane(spark, sf_dir), 5, 2).select("id", "knn"), "knn", digits=9)


@query("sorted_knn_curve_vectors", """
    SELECT id, round(knn, 9) AS knn, row_number() OVER (ORDER BY knn, id) - 1 AS rank FROM plane_knn""", ("plane_knn",))
def sorted_knn_curve_vectors(spark, sf_dir):
    return rounded(search.sorted_knn_curve(plane(spark, sf_dir), [], None, 5, 2), "knn", digits=9)


define("plane_edges", f"""
    SELECT a.id AS a, b.id AS b FROM plane a JOIN plane b
      ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {PLANE_EPS}""", "plane")


@query("connected_components", """
    WITH RECURSIVE reach(id, r) AS (
        SELECT a, b FROM plane_edges UNION SELECT reach.id, e.b FROM reach JOIN plane_edges e ON e.a = reach.r)
    SELECT id, min(r) AS component FROM reach GROUP BY id""", ("plane_edges",))
def connected_components(spark, sf_dir):
    """Components of the graph of plane points within eps, from its edges."""
    points = plane(spark, sf_dir)
    edges = nb.eps_neighbors(points, PLANE_EPS, 2).select(
        F.col("id").alias("a"), F.col("other").alias("b"))
    return nb.connected_components(points.select("id"), edges)


@query("eps_components", """
    WITH RECURSIVE reach(id, r) AS (
        SELECT a, b FROM plane_edges UNION SELECT reach.id, e.b FROM reach JOIN plane_edges e ON e.a = reach.r)
    SELECT id, min(r) AS component FROM reach GROUP BY id""", ("plane_edges",))
def eps_components(spark, sf_dir):
    """The same components from cells, without listing the edges."""
    return cl.eps_components(plane(spark, sf_dir), PLANE_EPS, 2).select("id", "component")


# ---- clusterings -----------------------------------------------------------------------


@query("dbscan_1d", "SELECT * FROM dbscan_labels", ("dbscan_labels",))
def dbscan_1d(spark, sf_dir):
    return dbscan_points(spark, sf_dir).select(*POINT, "id", "x", "label")


PLANE_DBSCAN = f"""
    WITH RECURSIVE cores AS (SELECT a AS id FROM plane_edges GROUP BY a HAVING count(*) >= {PLANE_MIN}),
    reach(id, r) AS (
        SELECT id, id FROM cores UNION
        SELECT reach.id, e.b FROM reach JOIN plane_edges e ON e.a = reach.r JOIN cores c ON c.id = e.b),
    parts AS (SELECT id, min(r) AS part FROM reach GROUP BY id),
    assigned AS (SELECT p.id, coalesce(any_value(own.part), min(near.part)) AS part
                 FROM plane p LEFT JOIN parts own ON own.id = p.id
                 LEFT JOIN plane_edges e ON e.a = p.id LEFT JOIN parts near ON near.id = e.b GROUP BY p.id)
    SELECT id, CASE WHEN part IS NULL THEN 0 ELSE CAST(dense_rank() OVER (
               PARTITION BY part IS NULL ORDER BY first_id) AS int) END AS label
    FROM (SELECT *, min(id) OVER (PARTITION BY part) AS first_id FROM assigned)"""


@query("dbscan", PLANE_DBSCAN, ("plane_edges",))
def dbscan(spark, sf_dir):
    return cl.dbscan(plane(spark, sf_dir), PLANE_EPS, PLANE_MIN, 2).select("id", "label")


@query("single_link_1d", "SELECT * FROM link_labels", ("link_labels",))
def single_link_1d(spark, sf_dir):
    return link_points(spark, sf_dir).select(*POINT, "id", "x", "label")


# Prim's tree: each round takes the point nearest to the tree and remembers the tree point it is nearest to.
@query("single_link", """
    WITH RECURSIVE start AS (SELECT * FROM plane ORDER BY id LIMIT 1),
    prim(id, x, y, d, parent, step) AS (
        SELECT p.id, p.x, p.y, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), s.id, 0
        FROM plane p, start s WHERE p.id <> s.id
        UNION ALL
        SELECT id, x, y, least(d, nd), CASE WHEN nd < d THEN mid ELSE parent END, step + 1 FROM (
            SELECT *, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS nd FROM (
                SELECT *, first_value(id) OVER w AS mid, first_value(x) OVER w AS mx, first_value(y) OVER w AS my,
                       row_number() OVER w AS r FROM prim WINDOW w AS (ORDER BY d, least(id, parent), greatest(id, parent)))
            WHERE r > 1)),
    tree AS (SELECT id, parent, d FROM (
                 SELECT *, row_number() OVER (PARTITION BY step ORDER BY d, least(id, parent), greatest(id, parent)) AS r
                 FROM prim) WHERE r = 1),
    cut AS (SELECT id FROM tree ORDER BY d DESC, least(id, parent) DESC, greatest(id, parent) DESC LIMIT 3),
    marked(id, root) AS (
        SELECT id, id FROM start UNION ALL SELECT id, id FROM cut UNION ALL
        SELECT t.id, m.root FROM marked m JOIN tree t ON t.parent = m.id AND t.id NOT IN (SELECT id FROM cut))
    SELECT id, CAST(dense_rank() OVER (ORDER BY first_id) - 1 AS int) AS label
    FROM (SELECT id, min(id) OVER (PARTITION BY root) AS first_id FROM marked)""", ("plane",))
def single_link(spark, sf_dir):
    """Four clusters of the plane points by single link."""
    return cl.single_link(plane(spark, sf_dir).select("id", "features"), 4, 2).select("id", "label")


define("vector_edges", f"""
    SELECT a.id AS a, b.id AS b, list_distance(a.f, b.f) AS d FROM vectors a JOIN vectors b ON list_distance(a.f, b.f) <= {VECTORS_EPS}""",
       "vectors")


def vectors(spark, sf_dir):
    return fx.features(spark, sf_dir).select("id", "features")


@query("eps_neighbors_vectors", "SELECT a AS id, b AS other, round(d, 6) AS distance FROM vector_edges", ("vector_edges",))
def eps_neighbors_vectors(spark, sf_dir):
    """All pairs of feature vectors of 64 numbers within eps."""
    return rounded(nb.eps_neighbors(vectors(spark, sf_dir), VECTORS_EPS, 64), "distance")


VECTORS_DBSCAN = PLANE_DBSCAN.replace("plane_edges", "vector_edges").replace("FROM plane p", "FROM vectors p").replace(
    f">= {PLANE_MIN})", f">= {VECTORS_MIN})")


@query("dbscan_vectors", VECTORS_DBSCAN, ("vector_edges",))
def dbscan_vectors(spark, sf_dir):
    """DBSCAN of the feature vectors."""
    return cl.dbscan(vectors(spark, sf_dir), VECTORS_EPS, VECTORS_MIN, 64).select("id", "label")


@query("cluster_job_vectors", "WITH RECURSIVE " + VECTORS_DBSCAN.strip()[15:].rpartition("\n    SELECT id, CASE")[0] + """,
    labelled AS (SELECT id, CASE WHEN part IS NULL THEN 0 ELSE CAST(dense_rank() OVER (
                     PARTITION BY part IS NULL ORDER BY first_id) AS int) END AS label
                 FROM (SELECT *, min(id) OVER (PARTITION BY part) AS first_id FROM assigned)),
    spots AS (SELECT id, label, unnest(range(1, 65)) AS dim, unnest(f) AS x FROM labelled JOIN (SELECT id, f FROM vectors) USING (id)),
    means AS (SELECT label, dim, avg(x) AS c FROM spots GROUP BY ALL)
    SELECT id, label, CASE WHEN label <> 0 THEN round(sqrt(sum((x - c) * (x - c))), 6) ELSE -1 END AS distance
    FROM spots JOIN means USING (label, dim) GROUP BY id, label""", ("vector_edges",))
def cluster_job_vectors(spark, sf_dir):
    """The points of a DBSCAN job over the feature vectors; noise has no distance (here -1)."""
    job = cl.cluster_job(vectors(spark, sf_dir), "dbscan", 64, eps=VECTORS_EPS, min_points=VECTORS_MIN)
    return rounded(job.points.select("id", "label", F.coalesce("distance", F.lit(-1.0)).alias("distance")), "distance")


@query("knn_distance_embeddings", """
    SELECT id, round(d, 6) AS knn FROM (
        SELECT a.id, list_distance(a.f, b.f) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f)) AS r
        FROM vectors a JOIN vectors b ON a.id <> b.id) WHERE r = 5""", ("vectors",))
def knn_distance_embeddings(spark, sf_dir):
    """The distance of every feature vector to its fifth neighbour."""
    return rounded(nb.knn_distance_vectors(vectors(spark, sf_dir), 5, 64).select("id", "knn"), "knn")


# Prim's tree over all pairs, as for the plane.
@query("single_link_vectors", """
    WITH RECURSIVE start AS (SELECT * FROM vectors ORDER BY id LIMIT 1),
    prim(id, f, d, parent, step) AS (
        SELECT p.id, p.f, list_distance(p.f, s.f), s.id, 0 FROM vectors p, start s WHERE p.id <> s.id
        UNION ALL
        SELECT id, f, least(d, nd), CASE WHEN nd < d THEN mid ELSE parent END, step + 1 FROM (
            SELECT *, list_distance(f, mf) AS nd FROM (
                SELECT *, first_value(id) OVER w AS mid, first_value(f) OVER w AS mf,
                       row_number() OVER w AS r FROM prim WINDOW w AS (ORDER BY d, least(id, parent), greatest(id, parent)))
            WHERE r > 1)),
    tree AS (SELECT id, parent, d FROM (
                 SELECT *, row_number() OVER (PARTITION BY step ORDER BY d, least(id, parent), greatest(id, parent)) AS r
                 FROM prim) WHERE r = 1),
    cut AS (SELECT id FROM tree ORDER BY d DESC, least(id, parent) DESC, greatest(id, parent) DESC LIMIT 7),
    marked(id, root) AS (
        SELECT id, id FROM start UNION ALL SELECT id, id FROM cut UNION ALL
        SELECT t.id, m.root FROM marked m JOIN tree t ON t.parent = m.id AND t.id NOT IN (SELECT id FROM cut))
    SELECT id, CAST(dense_rank() OVER (ORDER BY first_id) - 1 AS int) AS label
    FROM (SELECT id, min(id) OVER (PARTITION BY root) AS first_id FROM marked)""", ("vectors",))
def single_link_vectors(spark, sf_dir):
    """Eight clusters of the feature vectors by single link."""
    return cl.single_link(vectors(spark, sf_dir), 8, 64).select("id", "label")


def kmeans_sql(points: str, keys: str, k: str, rounds: int) -> str:
    """`km` (keys, r, cs): centroids of k-means over `points` (keys, id, f) after r rounds; starts are in `starts` (keys, cs)."""
    near = "list_transform(cs, lambda c: list_distance(p.f, c))"
    return f"""km AS (
        SELECT {keys}, 0 AS r, cs FROM starts
        UNION ALL
        SELECT {keys}, r + 1, list_transform(range(1, {k} + 1), lambda i: coalesce(found[i], cs[i]))
        FROM (SELECT {keys}, r, any_value(cs) AS cs, map_from_entries(list((label, mean))) AS found
              FROM (SELECT {keys}, r, label, any_value(cs) AS cs, list(x ORDER BY dim) AS mean
                    FROM (SELECT {keys}, r, label, dim, any_value(cs) AS cs, avg(x) AS x
                          FROM (SELECT {keys}, r, cs, label, unnest(range(1, 65)) AS dim, unnest(f) AS x
                                FROM (SELECT {keys}, r, cs, p.f, list_position({near}, list_min({near})) AS label
                                      FROM km JOIN {points} p USING ({keys}) WHERE r < {rounds}))
                          GROUP BY {keys}, r, label, dim)
                    GROUP BY {keys}, r, label)
              GROUP BY {keys}, r)),
    placed AS (SELECT {keys}, p.id, p.f, list_position({near}, list_min({near})) - 1 AS label, list_min({near}) AS distance
               FROM km JOIN {points} p USING ({keys}) WHERE r = {rounds})"""


@query("kmeans_fit", f"""
    WITH RECURSIVE spots AS (SELECT 1 AS one, id, f FROM vectors),
    races AS (SELECT one, id, f, i, -ln(((id * 7919 + i * 104729) % 10007 + 0.5) / 10007) AS t
              FROM spots, (SELECT unnest(range(0, 10)) AS i)),
    drawn AS (
        SELECT 0 AS j, (SELECT [arg_min(f, t)] FROM races WHERE i = 0) AS cs
        UNION ALL
        SELECT j + 1, list_append(any_value(cs), arg_min(f, t / (gap * gap)))
        FROM (SELECT j, cs, f, t, list_min(list_transform(cs, lambda c: list_distance(f, c))) AS gap
              FROM drawn JOIN races ON i = j + 1) WHERE gap > 0 GROUP BY j),
    starts AS (SELECT 1 AS one, cs FROM drawn WHERE j = 9),
    {kmeans_sql('spots', 'one', '10', KMEANS_ROUNDS)}
    SELECT id, CAST(label AS int) AS label, round(distance, 6) AS distance FROM placed""", ("vectors",))
def kmeans_fit(spark, sf_dir):
    """k-means with k = 10 over the feature vectors, seeded with numbers drawn by an arithmetic rule."""
    points = fx.features(spark, sf_dir).select("id", "features")
    rows = cl.kmeans_fit(points, 10, KMEANS_ROUNDS, draw=lambda i: ((F.col("id") * 7919 + i * 104729) % 10007 + 0.5) / 10007)
    return rounded(rows.select("id", "label", "distance"), "distance")


@query("gmm_fit")
def gmm_fit(spark, sf_dir):
    """Three mixture zones of the feature vectors."""
    rows = cl.gmm_fit(vectors(spark, sf_dir), 3, 64)
    return rounded(rows.select("id", "label", "probability"), "probability")


def lloyd_sql(points: str, key: str, k: int, rounds: int) -> str:
    """Fixed rounds of 1-D k-means over `points` (key, x), written out."""
    parts = [f"""c0 AS (SELECT {key}, i AS label, lo + (i + 0.5::DOUBLE) / {k} * (hi - lo) AS c
                 FROM (SELECT {key}, min(x) AS lo, max(x) AS hi FROM {points} GROUP BY ALL),
                      (SELECT unnest(range(0, {k})) AS i))"""]
    for r in range(rounds):
        parts.append(f"""a{r} AS (SELECT * FROM (
            SELECT p.{key}, p.x, p.w, c.label, row_number() OVER (PARTITION BY p.{key}, p.x
                ORDER BY sqrt((p.x - c.c) * (p.x - c.c)), c.label) AS r
            FROM (SELECT {key}, x, count(*) AS w FROM {points} GROUP BY ALL) p JOIN c{r} c USING ({key}))
            WHERE r = 1)""")
        parts.append(f"""c{r + 1} AS (SELECT c.{key}, c.label, coalesce(any_value(m.m), any_value(c.c)) AS c
            FROM c{r} c LEFT JOIN (SELECT {key}, label, sum(x * w) / sum(w) AS m FROM a{r} GROUP BY ALL) m
              ON m.{key} = c.{key} AND m.label = c.label GROUP BY c.{key}, c.label)""")
    return ",\n".join(parts)


@query("lloyd_step", f"""
    WITH {lloyd_sql('pts', 'data_type', 4, MERGE_ROUNDS)}
    SELECT data_type, CAST(label AS int) AS label, round(c, 6) AS centroid FROM c{MERGE_ROUNDS}""", ("pts",))
def lloyd_step(spark, sf_dir):
    """k-means with k = 4 on the readings of each data type, equal values taken together."""
    points = line(spark, sf_dir).groupBy("data_type", F.array("x").alias("features")).agg(
        F.count(F.lit(1)).alias("weight"))
    centers = cl.lloyd(points, ["data_type"], 4, MERGE_ROUNDS, 1)
    return rounded(centers.withColumn("centroid", F.col("centroid")[0]), "centroid")


@query("cf_merge_cluster", f"""
    WITH spots AS (SELECT 1 AS one, gateway_code, n, ls, ss, ls / n AS x FROM leaves),
    {lloyd_sql('spots', 'one', 3, MERGE_ROUNDS)},
    placed AS (SELECT * FROM (SELECT s.*, c.label, c.c, sqrt((s.x - c.c) * (s.x - c.c)) AS d,
                   row_number() OVER (PARTITION BY s.gateway_code, s.x, s.n, s.ls, s.ss, s.k
                                      ORDER BY sqrt((s.x - c.c) * (s.x - c.c)), c.label) AS r
               FROM (SELECT *, row_number() OVER () AS k FROM spots) s JOIN c{MERGE_ROUNDS} c ON true) WHERE r = 1)
    SELECT CAST(label + 1 AS int) AS cluster_id, round(any_value(c), 4) AS centroid,
           CAST(sum(n) AS bigint) AS point_count, round(max(d), 4) AS radius,
           string_agg(DISTINCT gateway_code, ',' ORDER BY gateway_code) AS members,
           sum(ls) AS ls, sum(ss) AS ss
    FROM placed GROUP BY label""", ("leaves",))
def cf_merge_cluster(spark, sf_dir):
    """Leaf CFs of all gateways fused to three clusters."""
    df = cl.cf_merge_cluster(leaves(spark, sf_dir), 1, rounds=MERGE_ROUNDS)
    return rounded(df.select("cluster_id", F.col("centroid")[0].alias("centroid"), "point_count",
                             "radius", F.array_join("member_gateways", ",").alias("members"),
                             F.col("ls")[0].alias("ls"), F.col("ss")[0].alias("ss")),
                   "centroid", "radius", digits=4)


@query("member_gateways", f"""
    WITH spots AS (SELECT 1 AS one, gateway_code, ls / n AS x FROM leaves),
    {lloyd_sql('spots', 'one', 3, MERGE_ROUNDS)},
    placed AS (SELECT * FROM (SELECT s.*, c.label, row_number() OVER (PARTITION BY s.k
                                     ORDER BY sqrt((s.x - c.c) * (s.x - c.c)), c.label) AS r
               FROM (SELECT *, row_number() OVER () AS k FROM spots) s JOIN c{MERGE_ROUNDS} c ON true) WHERE r = 1)
    SELECT DISTINCT CAST(label + 1 AS int) AS cluster, gateway_code FROM placed""", ("leaves",))
def member_gateways(spark, sf_dir):
    """Gateways whose leaves are in each merged cluster, one row each."""
    own = leaves(spark, sf_dir)
    merged = cl.cf_merge_cluster(own, 1, rounds=MERGE_ROUNDS).select(
        F.col("cluster_id").alias("label"), "centroid")
    placed = nb.nearest_centroid(own.withColumn("features", vec.divide(F.col("ls"), F.col("n"))), merged)
    return cl.member_gateways(placed.withColumnRenamed("label", "cluster"), "cluster")


@query("cluster_centroids", """
    SELECT label, n, dim - 1 AS dim, round(c, 6) AS centroid FROM centers""", ("centers",))
def cluster_centroids(spark, sf_dir):
    centers = cl.cluster_centroids(fx.features(spark, sf_dir), [], 64)
    long = centers.select("label", "n", F.posexplode("centroid").alias("dim", "centroid"))
    return rounded(long.withColumn("dim", F.col("dim").cast("bigint")), "centroid")


@query("label_counts", """
    SELECT measure_point_id, count(DISTINCT label) FILTER (label <> 0) AS n_clusters, count(*) AS n_points,
           count(*) FILTER (label = 0) AS n_noise FROM dbscan_labels GROUP BY ALL""", ("dbscan_labels",))
def label_counts(spark, sf_dir):
    return cl.cluster_totals(dbscan_points(spark, sf_dir), POINT)


@query("cluster_sizes", "SELECT label, count(*) AS n FROM dbscan_labels GROUP BY ALL", ("dbscan_labels",))
def cluster_sizes(spark, sf_dir):
    return cl.label_counts(dbscan_points(spark, sf_dir))


@query("distinct_labels", "SELECT DISTINCT label FROM dbscan_labels", ("dbscan_labels",))
def distinct_labels(spark, sf_dir):
    return cl.distinct_labels(dbscan_points(spark, sf_dir))


@query("renumber_labels", """
    SELECT id, CASE WHEN label = 7 THEN 0 ELSE CAST(dense_rank() OVER (PARTITION BY label = 7 ORDER BY first_id)
                                                AS int) END AS label
    FROM (SELECT vec_id AS id, label, min(vec_id) OVER (PARTITION BY label) AS first_id FROM embeddings)""")
def renumber_labels(spark, sf_dir):
    """Given labels renumbered by first appearance, with label 7 taken as noise."""
    return cl.renumber_labels(fx.features(spark, sf_dir), [], noise=7).select("id", "label")


# ---- scores ----------------------------------------------------------------------------

LINE_SILHOUETTE = """
    gaps AS (SELECT a.measure_point_id, a.id, a.label AS own, b.label, sum(abs(a.x - b.x)) AS total, count(*) AS n
             FROM {labels} a JOIN {labels} b USING (measure_point_id) GROUP BY ALL),
    per AS (SELECT measure_point_id, id, max(total) FILTER (own = label) AS t, max(n) FILTER (own = label) AS n,
                   min(total / n) FILTER (own <> label) AS b FROM gaps GROUP BY ALL),
    sil AS (SELECT measure_point_id, CASE WHEN n <= 1 OR b IS NULL OR greatest(t / (n - 1), b) = 0 THEN 0.0
                   ELSE (b - t / (n - 1)) / greatest(t / (n - 1), b) END AS s FROM per),
    ks AS (SELECT measure_point_id, count(DISTINCT label) AS k, count(*) AS n FROM {labels} GROUP BY ALL)
    SELECT measure_point_id, round(CASE WHEN any_value(k) > 1 AND any_value(k) < any_value(n)
                                        THEN avg(s) ELSE 0.0 END, 6) AS silhouette
    FROM sil JOIN ks USING (measure_point_id) GROUP BY measure_point_id"""


@query("silhouette", "WITH " + LINE_SILHOUETTE.format(labels="link_labels").strip(), ("link_labels",))
def silhouette(spark, sf_dir):
    """Exact mean silhouette of the single-link clusters of each measure point."""
    return rounded(quality.silhouette_1d(link_points(spark, sf_dir), POINT, "x"), "silhouette")


@query("silhouette_mixed", "WITH typed AS (SELECT measure_point_id, id, x, data_type AS label FROM pts),"
       + LINE_SILHOUETTE.format(labels="typed"), ("pts",))
def silhouette_mixed(spark, sf_dir):
    """The same with the data type as label: clusters that overlap on the line."""
    points = line(spark, sf_dir).withColumnRenamed("data_type", "label")
    return rounded(quality.silhouette_1d(points, POINT, "x"), "silhouette")


VECTOR_SILHOUETTE = """
    WITH gaps AS (SELECT a.id, a.label AS own, b.label, sum({d}) AS total, count(*) AS n
             FROM vectors a JOIN vectors b ON true GROUP BY ALL),
    per AS (SELECT id, max(total) FILTER (own = label) AS t, max(n) FILTER (own = label) AS n,
                   min(total / n) FILTER (own <> label) AS b FROM gaps GROUP BY ALL)
    SELECT round(avg(CASE WHEN n <= 1 THEN 0.0 ELSE (b - t / (n - 1)) / greatest(t / (n - 1), b) END), 6)
           AS silhouette FROM per"""


@query("silhouette_vectors", VECTOR_SILHOUETTE.format(d="list_distance(a.f, b.f)"), ("vectors",))
def silhouette_vectors(spark, sf_dir):
    return rounded(quality.silhouette_euclidean(fx.features(spark, sf_dir)), "silhouette")


@query("silhouette_squared",
       VECTOR_SILHOUETTE.format(d="list_distance(a.f, b.f) * list_distance(a.f, b.f)"), ("vectors",))
def silhouette_squared(spark, sf_dir):
    return rounded(quality.silhouette_squared(fx.features(spark, sf_dir), [], 64), "silhouette")


define("spread", """
    SELECT label, avg(d) AS s FROM (
        SELECT l.id, l.label, sqrt(sum((x - c) * (x - c))) AS d
        FROM long l JOIN centers c ON l.label = c.label AND l.dim = c.dim GROUP BY ALL) GROUP BY label""",
       "long", "centers")
define("dbi", """
    SELECT avg(r) AS davies_bouldin FROM (
        SELECT p.a, max((s1.s + s2.s) / p.d) AS r FROM (
            SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d
            FROM centers a JOIN centers b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL) p
        JOIN spread s1 ON s1.label = p.a JOIN spread s2 ON s2.label = p.b WHERE p.d > 0 GROUP BY p.a)""",
       "spread")
define("chi", """
    SELECT (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz, (br / (k - 1)) / (wr / (n - k)) AS unsquared, k, n
    FROM (SELECT sum(n * d2) AS b, sum(n * sqrt(d2)) AS br, count(*) AS k, sum(n) AS n FROM (
              SELECT label, any_value(n) AS n, sum((c - g) * (c - g)) AS d2
              FROM centers JOIN (SELECT dim, avg(x) AS g FROM long GROUP BY dim) USING (dim) GROUP BY label)),
         (SELECT sum(d2) AS w, sum(sqrt(d2)) AS wr FROM (
              SELECT l.id, sum((x - c) * (x - c)) AS d2 FROM long l
              JOIN centers c ON l.label = c.label AND l.dim = c.dim GROUP BY l.id))""", "centers")


@query("davies_bouldin", "SELECT round(davies_bouldin, 6) AS davies_bouldin FROM dbi", ("dbi",))
def davies_bouldin(spark, sf_dir):
    return rounded(quality.davies_bouldin(fx.features(spark, sf_dir), [], 64), "davies_bouldin")


@query("calinski_harabasz", """
    SELECT round(calinski_harabasz, 6) AS calinski_harabasz, round(unsquared, 6) AS unsquared FROM chi""",
       ("chi",))
def calinski_harabasz(spark, sf_dir):
    points = fx.features(spark, sf_dir)
    plain = quality.calinski_harabasz(points, [], 64, squared=False)
    both = quality.calinski_harabasz(points, [], 64).withColumn(
        "unsquared", plain.select("calinski_harabasz").scalar())
    return rounded(both, "calinski_harabasz", "unsquared")


@query("evaluate_clusters", f"""
    SELECT k AS n_clusters, CAST(n AS bigint) AS n_points, s.silhouette AS silhouette_squared,
           round(davies_bouldin, 6) AS davies_bouldin,
           round(calinski_harabasz, 6) AS calinski_harabasz
    FROM chi, dbi, ({VECTOR_SILHOUETTE.format(d="list_distance(a.f, b.f) * list_distance(a.f, b.f)")}) s""",
       ("vectors", "chi", "dbi"))
def evaluate_clusters(spark, sf_dir):
    return rounded(quality.evaluate_clusters(fx.features(spark, sf_dir), [], 64),
                   "silhouette_squared", "davies_bouldin", "calinski_harabasz")


def score_sql(labels: str, key: str, dims: tuple[str, ...], silhouette: str) -> str:
    """Metrics of `labels` (key, id, label, dims) per key, in plain SQL; `silhouette` is over distances d of a and b."""
    square = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in dims)
    d = silhouette.format(d=f"sqrt({square})", d2=f"({square})")
    means = ", ".join(f"avg({x}) AS {x}" for x in dims)
    return f"""
    gaps AS (SELECT a.{key}, a.id, a.label AS own, b.label, sum({d}) AS total, count(*) AS n
             FROM {labels} a JOIN {labels} b USING ({key}) GROUP BY ALL),
    per AS (SELECT {key}, id, max(total) FILTER (own = label) AS t, max(n) FILTER (own = label) AS n,
                   min(total / n) FILTER (own <> label) AS b FROM gaps GROUP BY ALL),
    sil AS (SELECT {key}, avg(CASE WHEN n <= 1 OR b IS NULL OR greatest(t / (n - 1), b) = 0 THEN 0.0
                                   ELSE (b - t / (n - 1)) / greatest(t / (n - 1), b) END) AS s FROM per GROUP BY {key}),
    mid AS (SELECT {key}, label, count(*) AS n, {means} FROM {labels} GROUP BY {key}, label),
    whole AS (SELECT {key}, {means} FROM {labels} GROUP BY {key}),
    inside AS (SELECT a.{key}, a.label, avg(sqrt({square})) AS s, sum({square}) AS w
               FROM {labels} a JOIN mid b ON a.{key} = b.{key} AND a.label = b.label GROUP BY a.{key}, a.label),
    ratios AS (SELECT a.{key}, a.label, max((i.s + j.s) / nullif(sqrt({square}), 0)) AS r
               FROM mid a JOIN mid b ON a.{key} = b.{key} AND a.label <> b.label
               JOIN inside i ON i.{key} = a.{key} AND i.label = a.label
               JOIN inside j ON j.{key} = b.{key} AND j.label = b.label GROUP BY a.{key}, a.label),
    dbis AS (SELECT mid.{key}, avg(coalesce(r, 0)) AS dbi FROM mid LEFT JOIN ratios USING ({key}, label) GROUP BY mid.{key}),
    between_sum AS (SELECT a.{key}, sum(a.n * ({square})) AS b, count(*) AS k, CAST(sum(a.n) AS bigint) AS n
                    FROM mid a JOIN whole b ON a.{key} = b.{key} GROUP BY a.{key}),
    chis AS (SELECT {key}, k, n, CASE WHEN k > 1 AND k < n AND w > 0 THEN (b / (k - 1)) / (w / (n - k)) ELSE 0 END AS chi
             FROM between_sum JOIN (SELECT {key}, sum(w) AS w FROM inside GROUP BY {key}) USING ({key}))
    SELECT {key}, k AS n_clusters, n AS n_points, round(CASE WHEN k > 1 AND k < n THEN s ELSE 0 END, 6) AS silhouette,
           round(dbi, 6) AS davies_bouldin, round(chi, 6) AS calinski_harabasz
    FROM chis JOIN dbis USING ({key}) JOIN sil USING ({key})"""


@query("evaluate_clusters_1d", """
    WITH clean AS (SELECT * FROM dbscan_labels WHERE label <> 0),""" + score_sql("clean", "measure_point_id", ("x",), "{d}"),
       ("dbscan_labels",))
def evaluate_clusters_1d(spark, sf_dir):
    """All scores of the DBSCAN clusters of each measure point, noise left out."""
    scores = quality.evaluate_clusters(dbscan_points(spark, sf_dir), POINT, 1, noise=0, value="x")
    return rounded(scores, "silhouette", "davies_bouldin", "calinski_harabasz")


@query("adjusted_rand", """
    WITH placed AS (SELECT id, label AS b FROM (
        SELECT l.id, c.label, row_number() OVER (PARTITION BY l.id
               ORDER BY sqrt(sum((l.x - c.c) * (l.x - c.c))), c.label) AS r
        FROM long l JOIN centers c USING (dim) GROUP BY l.id, c.label) WHERE r = 1),
    t AS (SELECT label AS a, b, count(*) AS n FROM vectors JOIN placed USING (id) GROUP BY ALL),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS ij,
                 (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS sa,
                 (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS sb,
                 (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM t) AS total)
    SELECT round((ij - sa * sb / total) / ((sa + sb) / 2.0 - sa * sb / total), 6) AS adjusted_rand FROM s""",
       ("centers", "vectors"))
def adjusted_rand(spark, sf_dir):
    """Given labels against those of the nearest of the labels' means."""
    points = fx.features(spark, sf_dir)
    means = cl.cluster_centroids(points, [], 64).select("label", "centroid")
    near = points.withColumn("__all", nb.centroid_list(means))
    best = nb.nearest_of(F.col("features"), F.col("__all"))["label"]
    pairs = near.select(F.col("label").alias("a"), best.alias("b"))
    return rounded(quality.adjusted_rand(pairs, [], "a", "b"), "adjusted_rand")


@query("js_drift", """
    WITH half AS (SELECT data_type, value_time < (SELECT min(ts) FROM events) + INTERVAL 15 DAY AS early
                  FROM stream_rows),
    p AS (SELECT data_type, count(*) / (SELECT count(*) FROM half WHERE early) AS p FROM half WHERE early GROUP BY 1),
    q AS (SELECT data_type, count(*) / (SELECT count(*) FROM half WHERE NOT early) AS q FROM half WHERE NOT early GROUP BY 1)
    SELECT round(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 8) AS js_divergence
    FROM p JOIN q USING (data_type)""", ("stream_rows",))
def js_drift(spark, sf_dir):
    rows = fx.reading_stream(spark, sf_dir)
    edge = rows.agg(F.min("value_time")).scalar() + F.expr("interval 15 days")
    return rounded(quality.js_drift(rows.filter(F.col("value_time") < edge),
                                    rows.filter(F.col("value_time") >= edge), "data_type"),
                   "js_divergence", digits=8)


# ---- jobs and search -------------------------------------------------------------------


PLANE_LABELS = "WITH RECURSIVE " + PLANE_DBSCAN.strip()[15:].rpartition("\n    SELECT id, CASE")[0] + """,
    labelled AS (SELECT id, CASE WHEN part IS NULL THEN 0 ELSE CAST(dense_rank() OVER (
                     PARTITION BY part IS NULL ORDER BY first_id) AS int) END AS label
                 FROM (SELECT *, min(id) OVER (PARTITION BY part) AS first_id FROM assigned)),
    spots AS (SELECT 1 AS one, id, label, x, y FROM labelled JOIN plane USING (id))"""


def plane_job(spark, sf_dir):
    return cl.cluster_job(plane(spark, sf_dir), "dbscan", 2, eps=PLANE_EPS, min_points=PLANE_MIN)


@query("cluster_job", PLANE_LABELS + """
    SELECT id, label, CASE WHEN label <> 0 THEN round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 6) ELSE -1 END AS distance
    FROM spots JOIN (SELECT label, avg(x) AS cx, avg(y) AS cy FROM spots GROUP BY label) USING (label)""", ("plane_edges",))
def cluster_job(spark, sf_dir):
    """A DBSCAN job over the parts: its points; noise has no distance (here -1)."""
    return rounded(plane_job(spark, sf_dir).points.select(
        "id", "label", F.coalesce("distance", F.lit(-1.0)).alias("distance")), "distance")


@query("cluster_job_evaluation", PLANE_LABELS + ", clean AS (SELECT * FROM spots WHERE label <> 0),"
       + score_sql("clean", "one", ("x", "y"), "{d2}").replace("SELECT one, k AS n_clusters", "SELECT k AS n_clusters").replace(
           "AS silhouette,", "AS silhouette_squared,"), ("plane_edges",))
def cluster_job_evaluation(spark, sf_dir):
    """The same job's metrics, without noise."""
    return rounded(plane_job(spark, sf_dir).evaluation, "silhouette_squared", "davies_bouldin", "calinski_harabasz")


@query("cluster_job_path", PLANE_LABELS + """, clean AS (SELECT * FROM spots WHERE label <> 0),"""
       + score_sql("clean", "one", ("x", "y"), "{d2}").replace("    SELECT one, k AS n_clusters", "    , score AS (SELECT k AS n_clusters")
       + """)
    SELECT 'job-7' AS job_id, 'dbscan' AS algorithm, 'completed' AS status, '1.05' AS eps, n_clusters, n_points,
           silhouette AS silhouette_score, davies_bouldin, calinski_harabasz, point_id, label
    FROM score, (SELECT id AS point_id, label FROM spots ORDER BY id LIMIT 20)""", ("plane_edges",))
def cluster_job_path(spark, sf_dir):
    """A job from its source table to its stored row, metrics and points, looked up again by its id."""
    at = latest_time(spark, sf_dir)
    root = scratch(spark, "jobs")
    params = {"eps": PLANE_EPS, "min_points": PLANE_MIN}
    job = plane_job(spark, sf_dir)
    tables.write_table(tables.job_row(spark, "job-7", "dbscan", params, "completed", at), f"{root}/job", "cluster_job")
    tables.write_table(tables.cluster_results(job.points, "job-7", F.lit(at)), f"{root}/result", "cluster_result")
    tables.write_table(tables.cluster_evals(job.evaluation, "job-7", "dbscan", params, F.lit(at)), f"{root}/eval", "cluster_eval")

    def back(name):
        return tables.read_table(spark, f"{root}/{name}", "created_at").filter("job_id = 'job-7'").drop("created_at")
    row = back("job").select("job_id", "algorithm", "status", F.col("params")["eps"].alias("eps"))
    found = row.join(back("eval").drop("params"), ["job_id", "algorithm"])
    page = tables.job_lookup(back("result"), "job-7").select("job_id", "point_id", "label")
    return rounded(found.join(page, "job_id"), "silhouette_score", "davies_bouldin", "calinski_harabasz")


@query("merge_result_sink", f"""
    WITH spots AS (SELECT 1 AS one, gateway_code, n, ls, ss, ls / n AS x FROM leaves),
    {lloyd_sql('spots', 'one', 3, MERGE_ROUNDS)},
    placed AS (SELECT * FROM (SELECT s.*, c.label, row_number() OVER (PARTITION BY s.k
                                     ORDER BY sqrt((s.x - c.c) * (s.x - c.c)), c.label) AS r
               FROM (SELECT *, row_number() OVER () AS k FROM spots) s JOIN c{MERGE_ROUNDS} c ON true) WHERE r = 1)
    SELECT 'merge-1' AS job_id, CAST(label + 1 AS int) AS cluster_id, CAST(sum(n) AS bigint) AS point_count,
           string_agg(DISTINCT gateway_code, ',' ORDER BY gateway_code) AS members, sum(ls) AS ls, sum(ss) AS ss
    FROM placed GROUP BY label""", ("leaves",))
def merge_result_sink(spark, sf_dir):
    """Fused clusters written to the merge-result table and read back."""
    path = scratch(spark, "merge_result")
    merged = cl.cf_merge_cluster(leaves(spark, sf_dir), 1, rounds=MERGE_ROUNDS)
    at = F.lit(latest_time(spark, sf_dir))
    tables.write_table(tables.merge_results(merged, "merge-1", at), path, "merge_result")
    return tables.read_table(spark, path, "created_at").select(
        "job_id", "cluster_id", "point_count", F.array_join("member_gateways", ",").alias("members"),
        F.col("ls")[0].alias("ls"), F.col("ss")[0].alias("ss"))


@query("cluster_result_sink", """
    SELECT 'job-1' AS job_id, id AS point_id, label AS cluster_id, label, round(list_sum(f), 6) AS total,
           round(distance, 6) AS distance, '2024-02-01 00:00:00.000000' AS created_at FROM placed_vectors""",
       ("placed_vectors",))
def cluster_result_sink(spark, sf_dir):
    """Labelled points with own-centroid distance, written to the result table and read back."""
    path = scratch(spark, "cluster_result")
    at = F.lit("2024-02-01").cast("timestamp")
    points = cl.with_own_distance(fx.features(spark, sf_dir), 64)
    tables.write_table(tables.cluster_results(points, "job-1", at), path, "cluster_result")
    back = tables.read_table(spark, path, "created_at").withColumn("total", vec.total(F.col("features")))
    return text_times(rounded(back.drop("features"), "total", "distance"), "created_at")


@query("cluster_eval_sink", """
    SELECT 'job-1' AS job_id, 'given' AS algorithm, round(davies_bouldin, 6) AS davies_bouldin,
           round(calinski_harabasz, 6) AS calinski_harabasz, k AS n_clusters, CAST(n AS bigint) AS n_points,
           s.silhouette AS silhouette_score, '10' AS k
    FROM chi, dbi, (""" + VECTOR_SILHOUETTE.format(d="list_distance(a.f, b.f) * list_distance(a.f, b.f)") + ") s",
       ("vectors", "chi", "dbi"))
def cluster_eval_sink(spark, sf_dir):
    """Metrics written twice to the evaluation table; the newest row per job and algorithm is read."""
    path = scratch(spark, "cluster_eval")
    scores = quality.evaluate_clusters(fx.features(spark, sf_dir), [], 64)
    for day in ("2024-02-01", "2024-02-02"):
        at = F.lit(day).cast("timestamp")
        rows = tables.cluster_evals(scores, "job-1", "given", {"k": 10}, at)
        tables.write_table(rows, path, "cluster_eval")
    back = tables.read_table(spark, path, "created_at")
    kept = tables.latest_by_key(back, ["job_id", "algorithm"], "created_at")
    return rounded(kept.select("job_id", "algorithm", "davies_bouldin", "calinski_harabasz", "n_clusters",
                               "n_points", "silhouette_score", F.col("params")["k"].alias("k")),
                   "davies_bouldin", "calinski_harabasz", "silhouette_score")


@query("job_lookup", """
    SELECT vec_id AS point_id, label FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 50""")
def job_lookup(spark, sf_dir):
    """The second page of 50 points of a stored job."""
    path = scratch(spark, "cluster_result")
    at = F.lit("2024-02-01").cast("timestamp")
    points = cl.with_own_distance(fx.features(spark, sf_dir), 64)
    tables.write_table(tables.cluster_results(points, "job-1", at), path, "cluster_result")
    stored = tables.read_table(spark, path, "created_at")
    return tables.job_lookup(stored, "job-1", page=2, page_size=50).select("point_id", "label")


@query("job_lookup_after", """
    SELECT vec_id AS point_id, label FROM embeddings WHERE vec_id > 49 ORDER BY vec_id LIMIT 50""")
def job_lookup_after(spark, sf_dir):
    """The page behind point 49, without counting off the points before."""
    at = F.lit("2024-02-01").cast("timestamp")
    rows = tables.cluster_results(cl.with_own_distance(fx.features(spark, sf_dir), 64), "job-1", at)
    return tables.job_lookup(rows, "job-1", page_size=50, after=49).select("point_id", "label")


@query("result_head", "SELECT vec_id AS point_id, label FROM embeddings ORDER BY vec_id LIMIT 50")
def result_head(spark, sf_dir):
    """The first 50 points of a job."""
    at = F.lit("2024-02-01").cast("timestamp")
    rows = tables.cluster_results(cl.with_own_distance(fx.features(spark, sf_dir), 64), "job-1", at)
    return tables.job_lookup(rows, "job-1", page=1, page_size=50).select("point_id", "label")


def first_vectors(points, k):
    """The k feature vectors with the lowest ids."""
    return [list(r["features"]) for r in points.orderBy("id").limit(k).collect()]


def _k_sql() -> str:
    low, high = VECTORS_K
    labelled, scores = [], []
    for k in range(low, high + 1):
        labelled.append(f"placed{k} AS (SELECT id, f, label FROM placed WHERE k = {k})")
        square = "list_distance(a.f, b.f) * list_distance(a.f, b.f)"
        sql = VECTOR_SILHOUETTE.format(d=square).replace("vectors", f"placed{k}")
        scores.append(f"SELECT {k} AS k, silhouette AS score FROM ({sql})")
    return f"""
    WITH RECURSIVE spots AS (SELECT unnest(range({low}, {high + 1})) AS k, id, f FROM vectors),
    starts AS (SELECT k, list(f ORDER BY id)[1:k] AS cs FROM spots GROUP BY k),
    {kmeans_sql('spots', 'k', 'len(cs)', LLOYD_ROUNDS)}, {', '.join(labelled)},
    scores AS ({' UNION ALL '.join(scores)})
    SELECT k, score, 'silhouette' AS metric, k = (SELECT k FROM scores ORDER BY score DESC, k LIMIT 1) AS is_best FROM scores"""


@query("find_optimal_k", _k_sql(), ("vectors",))
def find_optimal_k(spark, sf_dir):
    """Scores of k = 2 to 10 over the feature vectors, by k-means from fixed starts."""
    points, (low, high) = vectors(spark, sf_dir), VECTORS_K
    first = first_vectors(points, high)
    fits = cl.lloyd_fits(points, {k: first[:k] for k in range(low, high + 1)}, LLOYD_ROUNDS)
    rows = search.find_optimal_k(points, 64, VECTORS_K, clustering=lambda df, k: cl.nearest_label(df, fits[k]))
    return rounded(rows, "score")


define("curve", """
    SELECT data_type, d AS knn, row_number() OVER (PARTITION BY data_type ORDER BY d, id) - 1 AS rank FROM (
        SELECT a.data_type, a.id, abs(a.x - b.x) AS d,
               row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - b.x)) AS r
        FROM pts a JOIN pts b ON a.data_type = b.data_type AND a.id <> b.id) WHERE r = 5""", "pts")
define("unit_curve", """
    SELECT *, rank / n AS ux, (knn - lo) / (hi - lo + 1e-10) AS uy FROM (
        SELECT *, count(*) OVER g AS n, min(knn) OVER g AS lo, max(knn) OVER g AS hi
        FROM curve WINDOW g AS (PARTITION BY data_type))""", "curve")


@query("adaptive_eps", """
    WITH fit AS (SELECT data_type, covar_pop(ux, uy) * count(*) / (var_pop(ux) * count(*) + 1e-10) AS slope,
                        avg(ux) AS mx, avg(uy) AS my FROM unit_curve GROUP BY data_type),
    res AS (SELECT u.data_type, rank, knn, n, abs(uy - (slope * ux + my - slope * mx)) AS r
            FROM unit_curve u JOIN fit USING (data_type)),
    knee AS (SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY r DESC, rank) AS o,
                    avg(r) OVER (PARTITION BY data_type) AS mean_r FROM res)
    SELECT data_type, knn AS suggested_eps, rank AS knee_index, n AS n_points,
           CASE WHEN knn > 0 AND r > 2 * mean_r THEN 'high' WHEN knn > 0 AND r < 0.5 * mean_r THEN 'low'
                ELSE 'medium' END AS confidence FROM knee WHERE o = 1""", ("unit_curve",))
def adaptive_eps(spark, sf_dir):
    return search.adaptive_eps(line(spark, sf_dir), ["data_type"], "x")


@query("adaptive_eps_vectors", """
    WITH curve2 AS (SELECT id, knn, row_number() OVER (ORDER BY knn, id) - 1 AS rank FROM plane_knn),
    unit AS (SELECT *, rank / n AS ux, (knn - lo) / (hi - lo + 1e-10) AS uy FROM (
        SELECT *, count(*) OVER () AS n, min(knn) OVER () AS lo, max(knn) OVER () AS hi FROM curve2)),
    fit AS (SELECT covar_pop(ux, uy) * count(*) / (var_pop(ux) * count(*) + 1e-10) AS slope,
                   avg(ux) AS mx, avg(uy) AS my FROM unit),
    res AS (SELECT rank, knn, n, abs(uy - (slope * ux + my - slope * mx)) AS r FROM unit, fit),
    knee AS (SELECT *, row_number() OVER (ORDER BY r DESC, rank) AS o, avg(r) OVER () AS mean_r FROM res)
    SELECT round(knn, 9) AS suggested_eps, rank AS knee_index, n AS n_points,
           CASE WHEN knn > 0 AND r > 2 * mean_r THEN 'high' WHEN knn > 0 AND r < 0.5 * mean_r THEN 'low'
                ELSE 'medium' END AS confidence FROM knee WHERE o = 1""", ("plane_knn",))
def adaptive_eps_vectors(spark, sf_dir):
    return rounded(search.adaptive_eps(plane(spark, sf_dir), [], None, dim=2), "suggested_eps", digits=9)


def _stability_sql() -> str:
    return f"""
    WITH RECURSIVE spots AS (SELECT b, id, f FROM vectors, (SELECT unnest(range(0, {BOOTSTRAPS})) AS b)
                             WHERE (id * 7919 + b * 104729) % 1000 < 800),
    starts AS (SELECT b, list(f ORDER BY id)[1:3] AS cs FROM spots GROUP BY b),
    {kmeans_sql('spots', 'b', 'len(cs)', LLOYD_ROUNDS)},
    t AS (SELECT x.b AS b1, y.b AS b2, x.label AS l1, y.label AS l2, count(*) AS n
          FROM placed x JOIN placed y ON x.id = y.id AND x.b < y.b GROUP BY ALL),
    ij AS (SELECT b1, b2, sum(n * (n - 1) / 2.0) AS ij, sum(n) * (sum(n) - 1) / 2.0 AS total FROM t GROUP BY ALL),
    sa AS (SELECT b1, b2, sum(n * (n - 1) / 2.0) AS sa FROM (SELECT b1, b2, sum(n) AS n FROM t GROUP BY b1, b2, l1) GROUP BY ALL),
    sb AS (SELECT b1, b2, sum(n * (n - 1) / 2.0) AS sb FROM (SELECT b1, b2, sum(n) AS n FROM t GROUP BY b1, b2, l2) GROUP BY ALL)
    SELECT round(avg((ij - sa * sb / total) / ((sa + sb) / 2.0 - sa * sb / total)), 4) AS stability, count(*) AS pairs
    FROM ij JOIN sa USING (b1, b2) JOIN sb USING (b1, b2)"""


@query("stability", _stability_sql(), ("vectors",))
def stability(spark, sf_dir):
    """Agreement of ten k-means runs from fixed starts on samples drawn by an arithmetic rule."""
    points = vectors(spark, sf_dir)

    def drawn(b):
        return (F.col("id") * 7919 + b * 104729) % 1000 < 800

    starts = {b: first_vectors(points.filter(drawn(b)), 3) for b in range(BOOTSTRAPS)}
    fits = cl.lloyd_fits(points, starts, LLOYD_ROUNDS, drawn)
    runs = [lambda df, cs=fits[b]: cl.nearest_label(df, cs) for b in range(BOOTSTRAPS)]
    return rounded(search.stability(points, runs, BOOTSTRAPS, drawn=drawn), "stability", digits=4)
