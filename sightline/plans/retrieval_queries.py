"""Queries of the vocabulary tree and of feature matches, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matches, pairs, vocabulary
from .bindings import bound, duck

BRANCHING, DEPTH, ROUNDS, PARTS, WIDTH = 4, 2, 2, 8, 8


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Eight features of each observation: the parts of its descriptor."""
    d = bound(spark, sf, "descriptors").select("observation_id", "descriptor", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("feature_index"))
    return vocabulary.whole_features(d.select("observation_id", F.col("feature_index").cast("long").alias("feature_index"), F.slice("descriptor", F.col("feature_index") * WIDTH + 1, WIDTH).alias("descriptor")))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    features = _features(spark, sf)
    tree = vocabulary.train_tree(features, branching=BRANCHING, depth=DEPTH, rounds=ROUNDS)
    return vocabulary.feature_words(features, tree, branching=BRANCHING)


def j5_feature_words(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf)


def j5_tree_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.tree_pairs(_words(spark, sf), 3, heavy=200)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = bound(spark, sf, "descriptors").select(F.lit("all").alias("sequence_id"), "observation_id", F.substring("observation_id", 2, 9).cast("bigint").alias("position"))
    return pairs.sequential_pairs(d, 4).select("id1", "id2")


def x2_mutual_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matches.mutual_matches(_candidates(spark, sf), _features(spark, sf), ratio_percent=90)


def x2_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matches.match_counts(_candidates(spark, sf), x2_mutual_matches(spark, sf))


QUERIES = {"j5_feature_words": j5_feature_words, "j5_tree_pairs": j5_tree_pairs, "x2_mutual_matches": x2_mutual_matches, "x2_match_counts": x2_match_counts}

FEATURES = f"""{duck('descriptors')},
f AS MATERIALIZED (SELECT observation_id, k AS feature_index, list_transform(descriptor[k * {WIDTH} + 1:(k + 1) * {WIDTH}], lambda x: floor(1024 * x::DOUBLE)) AS v FROM descriptors, range({PARTS}) r(k))"""


def _tree_sql() -> str:
    """Tables n<level> give each feature its node, c<level>_<round> hold the centroids."""
    steps = ["n0 AS MATERIALIZED (SELECT *, 0::BIGINT AS node FROM f)"]
    for level in range(DEPTH):
        steps.append(f"""c{level}_0 AS MATERIALIZED (SELECT node, child, v AS x FROM (SELECT node, v, row_number() OVER (PARTITION BY node ORDER BY sha256('3,' || array_to_string(list_transform(v, lambda y: y::BIGINT), ',')), v) - 1 AS child FROM (SELECT DISTINCT node, v FROM n{level})) WHERE child < {BRANCHING})""")
        for r in range(ROUNDS + 1):
            near = f"(SELECT observation_id, feature_index, v, n.node, arg_min(child, {{'d': list_dot_product(v, v) - 2 * list_dot_product(v, x) + list_dot_product(x, x), 'c': child}}) AS child FROM n{level} n JOIN c{level}_{r} c ON c.node = n.node GROUP BY ALL)"
            if r == ROUNDS:
                steps.append(f"n{level + 1} AS MATERIALIZED (SELECT observation_id, feature_index, v, node * {BRANCHING} + child AS node FROM {near})")
            else:
                steps.append(f"""c{level}_{r + 1} AS MATERIALIZED (SELECT c.node, c.child, coalesce(y, x) AS x FROM c{level}_{r} c LEFT JOIN (SELECT node, child, list(m ORDER BY dim) AS y FROM (
  SELECT node, child, dim, floor(sum(e) / count(*)) AS m FROM (SELECT node, child, unnest(v) AS e, unnest(range({WIDTH})) AS dim FROM {near}) GROUP BY ALL) GROUP BY 1, 2) USING (node, child))""")
    steps.append(f"words AS (SELECT observation_id, node AS word, count(*) AS n FROM n{DEPTH} GROUP BY 1, 2)")
    return f"{FEATURES}, " + ",\n".join(steps)


MATCHES = f"""{FEATURES},
p AS (SELECT a.observation_id AS id1, b.observation_id AS id2 FROM descriptors a JOIN descriptors b ON substr(b.observation_id, 2)::BIGINT - substr(a.observation_id, 2)::BIGINT BETWEEN 1 AND 4),
d AS MATERIALIZED (SELECT id1, id2, a.feature_index AS feature1, b.feature_index AS feature2, (list_dot_product(a.v, a.v) - 2 * list_dot_product(a.v, b.v) + list_dot_product(b.v, b.v))::BIGINT AS distance
  FROM p JOIN f a ON a.observation_id = id1 JOIN f b ON b.observation_id = id2),
r AS (SELECT *, row_number() OVER w1 AS k1, row_number() OVER w2 AS k2, lead(distance) OVER w1 AS s1, lead(distance) OVER w2 AS s2 FROM d
  WINDOW w1 AS (PARTITION BY id1, id2, feature1 ORDER BY distance, feature2), w2 AS (PARTITION BY id1, id2, feature2 ORDER BY distance, feature1)),
m AS (SELECT id1, id2, feature1, feature2, distance FROM r WHERE k1 = 1 AND k2 = 1 AND coalesce(distance * 10000 < s1 * 8100, true) AND coalesce(distance * 10000 < s2 * 8100, true))"""

ORACLES = {
    "j5_feature_words": f"{_tree_sql()} SELECT * FROM words",
    "j5_tree_pairs": f"""{_tree_sql()},
t AS (SELECT observation_id, word, n / sum(n) OVER (PARTITION BY observation_id) * ln((SELECT count(DISTINCT observation_id) FROM words) / count(*) OVER (PARTITION BY word)::DOUBLE) AS t FROM words),
u AS MATERIALIZED (SELECT observation_id, word, t / sqrt(sum(t * t) OVER (PARTITION BY observation_id)) AS w FROM t),
s AS (SELECT a.observation_id AS a, b.observation_id AS b, round(sum(a.w * b.w), 9) AS s FROM u a JOIN u b ON a.word = b.word AND a.observation_id <> b.observation_id WHERE a.w > 0 AND b.w > 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s)
SELECT least(a, b) AS id1, greatest(a, b) AS id2, max(s) AS similarity FROM k WHERE k <= 3 GROUP BY 1, 2""",
    "x2_mutual_matches": f"{MATCHES} SELECT * FROM m",
    "x2_match_counts": f"{MATCHES} SELECT p.id1, p.id2, count(feature1) AS raw_matches FROM p LEFT JOIN m ON m.id1 = p.id1 AND m.id2 = p.id2 GROUP BY 1, 2",
}
