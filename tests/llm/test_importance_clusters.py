import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spectrail.llm import centroids, importance

from .conftest import AWKWARD


def plain_grams(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, n, buckets, least, percent, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in plain_grams(text, n)[1]) for texts in ([t for _, t in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        words, grams = plain_grams(text, n)
        weight = sum(gain(bucket(g)) for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


TEXTS = [*AWKWARD[:-2], (5, "long words " * 3000), *((50 + i, " ".join(f"W{(i * j) % 13}é" for j in range(i))) for i in range(45)), (60, "again " * 25), (60, "again " * 25)]


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("size", [16 << 20, 60])
def test_resampling_by_brute_force(spark, docs_of, monkeypatch, n, size):
    monkeypatch.setattr(importance, "chunks", lambda rows, table, k: __import__("spectrail.llm.word_tables", fromlist=["chunks"]).chunks(rows, table, k, size))
    target = ["w1é w2é again", None, "", "only here w3é"]
    wanted = spark.createDataFrame([(t, 1.0) for t in target], "text string, score double")
    got = importance.resample(docs_of(TEXTS).repartition(3), wanted, n, 97, least_words=10, percent=40)
    assert Counter(map(tuple, got.collect())) == brute_resample(TEXTS, target, n, 97, 10, 40)


def test_resampling_of_empty_tables(spark, docs_of):
    nothing = spark.createDataFrame([], "text string")
    rows = [(1, "a b"), (2, None)]
    assert importance.resample(docs_of(rows).limit(0), nothing).count() == 0
    got = importance.resample(docs_of(rows), nothing, least_words=1, percent=100).collect()
    assert Counter(map(tuple, got)) == brute_resample(rows, [], 1, 10_000, 1, 100)


def test_ranks_come_from_ranges(spark):
    rows = spark.range(1000).selectExpr("id % 7 as a", "id as b")
    got = sorted((r.place, r.a, r.b) for r in importance.ranked(rows, [rows["a"].desc(), rows["b"]]).collect())
    assert [p for p, *_ in got] == list(range(1, 1001)) and [x[1:] for x in got] == sorted(((r.a, r.b) for r in rows.collect()), key=lambda r: (-r[0], r[1]))


# -- clusters --------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, size, scale, seed):
    kept = [(i, [max(-centroids.MOST, min(centroids.MOST, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    own = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(own))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for j in set(found):
            mine = [v for (_, v), c in zip(kept, found, strict=True) if c == j]
            own[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    sums = Counter()
    for _, d, c in last:
        sums[c] += d
    fits = lambda x: x if x < 2**63 else None
    return Counter((i, c, d, fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, own[c])).encode()).hexdigest()) for i, d, c in last)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, cluster string, v double, n int"
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 0.5, 2) for i, v in rows], schema).repartition(3)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_clusters_by_brute_force(spark, rounds):
    rng = np.random.default_rng(1)
    data = rng.integers(-8, 8, (60, 3)) / 4.0  # many ties
    rows = [*((i, v.tolist()) for i, v in enumerate(data)), (7, data[7].tolist()), (None, [0.25, 0.5, -0.5]), (None, [0.25, 0.5, -0.5])]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [math.nan, 0, 0]), (105, [0, math.inf, 0]), (106, [0, -math.inf, 0]), (107, [3e38, -3e38, 1.0]), (108, [2.0**19, 2.0**19, 0.0])]
    got = centroids.cluster(vectors(spark, rows), 9, rounds, 3, 256, 5, cut_every=2)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, 9, rounds, 3, 256, 5)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5]), (1, [0.5]), (2, [0.25])]
    assert Counter(map(tuple, centroids.cluster(vectors(spark, rows), 5, 2, 1).collect())) == brute_clusters(rows, 5, 2, 1, 256, 2)
    none = centroids.cluster(vectors(spark, [(1, [0.5])]), size=64)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        centroids.cluster(vectors(spark, rows), size=200)


def test_annulus_leaves_centroids_away_and_keeps_ties():
    rng = np.random.default_rng(0)
    own = (rng.integers(1, 400, (50, 1)) * rng.integers(-3, 4, (50, 8))).astype(np.int64)
    x = np.concatenate([own[rng.integers(50, size=300)] + rng.integers(-2, 3, (300, 8)), own[:5], (own[:5] + own[5:10]) // 2])
    search = centroids.Annulus(own)
    d = ((x[:, None] - own[None]) ** 2).sum(axis=2)
    for before in (None, rng.integers(50, size=len(x)), d.argmin(axis=1)):
        best, least, compared = search.nearest(x, before)
        assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
    assert compared < 0.3 * d.size
