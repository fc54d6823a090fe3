"""The vocabulary tree, tf-idf retrieval and mutual matches, by brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.operators import matches, vocabulary
from sightline.operators.checks import InvalidInput

FEATURES = "observation_id string, feature_index long, descriptor array<double>"


def features(seed, observations=12, width=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for o in range(observations):
        for k in range(rng.randint(0, 9)):
            rows.append((f"o{o:02d}", k, [c + rng.choice([0, 0, 0.05, -0.1]) for c in rng.choice(centres)]))
    return rows


def whole(v):
    return [math.floor(1024 * x) for x in v]


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_words(rows, branching, depth, rounds, seed=3):
    node = {r[:2]: 0 for r in rows}
    at = {r[:2]: whole(r[2]) for r in rows}
    for _ in range(depth):
        down = {}
        for n in set(node.values()):
            own = [k for k in node if node[k] == n]
            order = sorted({tuple(at[k]) for k in own}, key=lambda v: (hashlib.sha256(",".join(map(str, (seed, *v))).encode()).hexdigest(), v))
            centres = [list(v) for v in order[:branching]]
            for r in range(rounds + 1):
                child = {k: min(range(len(centres)), key=lambda c: (gap(at[k], centres[c]), c)) for k in own}
                if r < rounds:
                    for c in range(len(centres)):
                        mine = [at[k] for k in own if child[k] == c]
                        if mine:
                            centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
            down |= {k: n * branching + child[k] for k in own}
        node = down
    return Counter((k[0], w) for k, w in node.items())


def plain_pairs(words, neighbors):
    ids = sorted({o for o, _ in words})
    df = Counter(w for _, w in words)
    total = Counter()
    for (o, _), n in words.items():
        total[o] += n
    weight = {(o, w): n / total[o] * math.log(len(ids) / df[w]) for (o, w), n in words.items()}
    norm = {o: math.sqrt(sum(x * x for (p, _), x in weight.items() if p == o)) for o in ids}
    out = {}
    for a in ids:
        scored = []
        for b in ids:
            common = [w for o, w in words if o == a and weight[a, w] > 0 and weight.get((b, w), 0) > 0]
            if a != b and common:
                scored.append((-round(sum(weight[a, w] / norm[a] * weight[b, w] / norm[b] for w in common), 9), b))
        for s, b in sorted(scored)[:neighbors]:
            out[min(a, b), max(a, b)] = -s
    return out


@pytest.mark.parametrize("seed, branching, depth", [(0, 2, 2), (1, 3, 1), (2, 4, 3)])
def test_words_and_pairs_equal_brute_force(spark, seed, branching, depth):
    rows = features(seed)
    found = vocabulary.whole_features(spark.createDataFrame(rows, FEATURES))
    tree = vocabulary.train_tree(found, branching=branching, depth=depth, rounds=2)
    words = vocabulary.feature_words(found, tree, branching=branching).cache()
    want = plain_words(rows, branching, depth, 2)
    assert {(r.observation_id, r.word): r.n for r in words.collect()} == dict(want)
    for heavy in (0, 2, 4, 100):
        for neighbors in (1, 3):
            got = {(r.id1, r.id2): r.similarity for r in vocabulary.tree_pairs(words, neighbors, heavy=heavy).collect()}
            plain = plain_pairs(want, neighbors)
            assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 2e-9 for k in plain)


@pytest.mark.parametrize(("neighbors", "heavy"), [(1, 100), (3, 4), (3, 0)])
def test_equal_observations_are_compared_once(spark, monkeypatch, neighbors, heavy):
    rng = random.Random(7)
    kinds = [{w: rng.randint(1, 3) for w in rng.sample(range(8), rng.randint(1, 3))} for _ in range(9)]
    of = {f"o{k:02d}": kinds[k % 9] for k in rng.sample(range(40), 40)}
    of["p0"] = kinds[0] | {8: 1}  # one of its own
    words = {(o, w): n for o, x in of.items() for w, n in x.items()}
    sizes, asked = {}, vocabulary.best_in_blocks
    monkeypatch.setattr(vocabulary, "best_in_blocks", lambda queries, rows, *a: sizes.setdefault("rows", rows.count()) and asked(queries, rows, *a))
    table = spark.createDataFrame([(o, w, n) for (o, w), n in words.items()], "observation_id string, word long, n long")
    got = {(r.id1, r.id2): r.similarity for r in vocabulary.tree_pairs(table, neighbors, heavy=heavy).collect()}
    plain = plain_pairs(words, neighbors)
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 2e-9 for k in plain)
    assert sizes["rows"] <= 10


def test_features_that_break_rules(spark):
    good = ("o", 0, [0.0, 1.0])
    for bad, message in (([good, good], "twice"), ([good, ("o", 1, [0.0])], "width"), ([("o", 1, None)], "malformed"), ([("o", 1, [float("nan")])], "malformed"), ([("o", 1, [0.0, None])], "malformed"), ([(None, 1, [0.0])], "malformed"), ([("o", 1, [1e9])], "malformed")):
        with pytest.raises(InvalidInput, match=message):
            vocabulary.whole_features(spark.createDataFrame(bad, FEATURES))
    none = vocabulary.whole_features(spark.createDataFrame([], FEATURES))
    tree = vocabulary.train_tree(none, branching=2, depth=2, rounds=1)
    assert tree.count() == 0 and vocabulary.feature_words(none, tree, branching=2).count() == 0
    with pytest.raises(ValueError, match="too large"):
        vocabulary.Level([type("R", (), {"node": 0, "child": 0, "x": [0] * (1 << 20)})], 1 << 10)


def plain_matches(x, y, percent):
    def near(a, others):
        order = sorted((gap(a[1], b[1]), b[0]) for b in others)
        return order[0], (order[1][0] if len(order) > 1 else math.inf)

    out = set()
    for a in x:
        (d, j), second = near(a, y)
        (e, i), other = near(next(b for b in y if b[0] == j), x)
        if i == a[0] and d * 10_000 < second * percent**2 and e * 10_000 < other * percent**2:
            out.add((a[0], j, d))
    return out


@pytest.mark.parametrize("block", [200, 32 << 20])
def test_matches_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(matches, "BLOCK_BYTES", block)
    monkeypatch.setattr(matches, "STEP", 4)
    rows = [r for s in (3, 4) for r in [(f"{s}{o}", k, v) for o, k, v in features(s, 6)]] + [("z1", 5, [0.1, 0.2, 0.3]), ("z2", 9, [0.1, 0.2, 0.4])]
    names = sorted({f"{s}o{o:02d}" for s in (3, 4) for o in range(6)} | {"z1", "z2", "none"})
    pairs = [(a, b) for a in names for b in names if a < b]
    found = vocabulary.whole_features(spark.createDataFrame(rows, FEATURES))
    candidates = spark.createDataFrame(pairs, "id1 string, id2 string")
    raw = matches.mutual_matches(candidates, found, ratio_percent=95).cache()
    by = {}
    for o, k, v in rows:
        by.setdefault(o, []).append((k, whole(v)))
    want = {(a, b, *m) for a, b in pairs if a in by and b in by for m in plain_matches(by[a], by[b], 95)}
    assert {tuple(r) for r in raw.collect()} == want and len(want) > 20 and ("z1", "z2", 5, 9, gap(whole([0.1, 0.2, 0.3]), whole([0.1, 0.2, 0.4]))) in want
    counts = {(r.id1, r.id2): r.raw_matches for r in matches.match_counts(candidates, raw).collect()}
    per_pair = Counter(m[:2] for m in want)
    assert counts == {p: per_pair.get(p, 0) for p in pairs}
    for bad, message in (([("b", "a")], "order"), ([("a", "b")] * 2, "twice"), ([("a", None)], "order")):
        with pytest.raises(InvalidInput, match=message):
            matches.mutual_matches(spark.createDataFrame(bad, "id1 string, id2 string"), found)
    sent_once = matches.mutual_matches(candidates.where(F.lit(False)), found).collect()
    assert sent_once == []


@pytest.mark.parametrize(("block", "strip", "words_at_once"), [(4096, 256, 512), (7, 2, 3)])
def test_best_in_blocks_equals_brute_force(spark, block, strip, words_at_once):
    rng = random.Random(4)
    vectors = {f"o{k:03d}": {w: rng.choice([0.25, 0.5, 1.0]) for w in rng.sample(range(12), rng.randint(1, 4))} for k in range(60)}
    rows = spark.createDataFrame([(o, list(x), list(x.values())) for o, x in vectors.items()], "observation_id string, words array<long>, weights array<double>")
    found = vocabulary.best_in_blocks(rows.where("observation_id < 'o040'"), rows, 3, block=block, strip=strip, words_at_once=words_at_once).collect()
    for a in sorted(vectors)[:40]:
        scores = {b: round(sum(w * x[k] for k, w in vectors[a].items() if k in x), 9) for b, x in vectors.items() if b != a and set(x) & set(vectors[a])}
        want = sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:3]
        assert sorted(((r.b, r.s) for r in found if r.a == a), key=lambda e: (-e[1], e[0]))[:3] == want


def test_common_words_are_no_join(spark):
    # all observations have the words, so all pairs would meet in a join on them
    words = spark.range(64).selectExpr("cast(id as string) as observation_id", "explode(array(id % 3, 3 + id % 2)) as word", "1L as n")
    plan = vocabulary.tree_pairs(words, 3, heavy=4)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan
