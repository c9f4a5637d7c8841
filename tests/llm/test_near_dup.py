from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrail.llm import near_dup, oracles, queries

from .conftest import AWKWARD

DIR = "/root/testdata/sf0.001"


def brute(rows, percent=80, size=2):
    """(doc_id, n_shingles, component_id, kept) of each row, from all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return Counter((i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def as_counter(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def copies(seed, groups=12, size=8):
    """Groups of texts with more and more changed words, so that similarities lie around 0.8."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        words = [f"g{g}w{v}" for v in rng.integers(0, 60, 50)]
        for k in range(size):
            own = list(words)
            for at in rng.integers(0, 50, k):
                own[at] = f"x{rng.integers(1000)}"
            rows.append((int(rng.integers(10_000)) * 100 + len(rows), " ".join(own)))
    return rows


def test_components_by_brute_force(spark, docs_of):
    rows = [*AWKWARD, (50, "ONE"), (51, "one"), (52, "a b"), (53, "A\tB"), (54, "é É"), *copies(0), *copies(1, 4, 20)]
    assert as_counter(near_dup.near_duplicates(docs_of(rows))) == brute(rows)


def test_small_cells_give_the_same(spark, docs_of, monkeypatch):
    rows = copies(2, 2, 40)
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    monkeypatch.setattr(near_dup, "SLICE", 3)
    assert as_counter(near_dup.near_duplicates(docs_of(rows))) == brute(rows)


def test_empty_and_single(spark, docs_of):
    assert near_dup.near_duplicates(docs_of([(1, "x y")]).limit(0)).count() == 0
    for rows in ([(1, "x y")], [(1, None), (2, "")], [(None, "a"), (None, "a")]):
        assert as_counter(near_dup.near_duplicates(docs_of(rows))) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, near_dup.LIMIT))
def test_signatures_within_the_limit_share_a_key(seed, apart):
    """The pigeonhole promise: however the differing places lie."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**16, near_dup.PLACES).astype(np.uint16)
    b = a.copy()
    at = rng.permutation(near_dup.PLACES)[:apart] if seed % 2 else np.arange(apart)
    b[at] ^= np.uint16(1)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([a.tobytes(), b.tobytes()])], ["node", "sig"])
    keys = next(near_dup._keys(iter([batch]))).to_pydict()
    own = {n: {k for k, m in zip(keys["key"], keys["node"]) if m == n} for n in (0, 1)}
    assert own[0] & own[1]


def test_stars(spark):
    edges = [(5, 4), (4, 3), (3, 1), (9, 8), (8, 7), (9, 7), (20, 10), (20, 11), (11, 12)]
    got = {r.node: r.root for r in near_dup.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    full = got | {r: r for r in got.values()}
    assert full == {1: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 10: 10, 11: 10, 12: 10, 20: 10}
    long = near_dup.stars(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect()
    assert {r.root for r in long} == {0} and len(long) == 60


def test_stage_keeps_one_of_each_group(spark, docs_of):
    rows = [*AWKWARD, *copies(3, 4, 6)]
    docs = docs_of(rows)
    kept = near_dup.first_of_groups(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, _, k in brute(rows) if k and i is not None}
    got = [r.doc_id for r in kept.collect()]
    assert Counter(i for i in got if i is not None) == Counter(want) and got.count(None) == 2


def test_stage_decides_by_row_where_ids_repeat_or_are_null(spark, docs_of):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (1, b), (1, f"{a} more"), (2, b), (2, c), (3, c), (None, a), (None, d), (None, d), (None, f"{d} more"), (4, ""), (None, "")]
    got = Counter((r.doc_id, r.text[:1]) for r in near_dup.first_of_groups(docs_of(rows)).collect())
    assert got == Counter([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, ""), (None, "")])


def brute_rows(rows, size):
    """(doc_id, text) of the rows that stay: the first row by id of each component, rows without words, null ids last."""
    sets = [frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if (w := (t or "").lower().split()) else None for _, t in rows]
    left, out = {k for k, v in enumerate(sets) if v}, [x for x, v in zip(rows, sets) if not v]
    while left:
        todo, seen = [left.pop()], []
        while todo:
            k = todo.pop()
            seen.append(k)
            near = {m for m in left if 100 * len(sets[k] & sets[m]) >= 80 * len(sets[k] | sets[m])}
            left -= near
            todo += near
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((min(ids, default=None), sorted(seen)))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_stage_by_brute_force_with_repeated_ids(spark, docs_of, size):
    """Random tables whose ids repeat over like and unlike texts: of each component one row with the smallest id stays."""
    rng = np.random.default_rng(size)
    texts = [t for _, t in copies(11, 6, 5)] + ["", None]
    rows = [(None if rng.random() < 0.1 else int(rng.integers(25)), texts[rng.integers(len(texts))]) for _ in range(90)]
    got = Counter((r.doc_id, r.text) for r in near_dup.first_of_groups(docs_of(rows), size=size).collect())
    want, empty = [x for x in brute_rows(rows, size) if isinstance(x[1], list)], Counter(x for x in rows if not x[1])
    assert Counter({x: n for x, n in got.items() if not x[1]}) == empty
    kept = [x for x, n in got.items() if x[1] for _ in range(n)]
    assert len(kept) == len(want)
    for first, members in want:
        own = {rows[k] for k in members}
        assert len([x for x in kept if x in own and x[0] == first]) == 1


def test_of_equal_sets_the_smallest_row_stays(spark, docs_of):
    rows = [(1, "A b c d e f"), (1, "a b c d e f"), (1, "a  b c d e f"), (None, "x y z u v w"), (None, "X y z u v w")]
    for own in (rows, rows[::-1]):
        got = {(r.doc_id, r.text) for r in near_dup.first_of_groups(docs_of(own).repartition(3), size=5).collect()}
        assert got == {(1, "A b c d e f"), (None, "X y z u v w")}


@pytest.mark.parametrize("percent", [80, 100])
def test_parts_by_size_lose_no_link(spark, docs_of, percent):
    """Sets of growing size, each near the next: links between neighbouring parts of a locale are found."""
    words, rows = [f"w{i}" for i in range(400)], []
    for k in range(60):
        rows.append((k, " ".join(words[: 20 + 6 * k])))
        rows.append((100 + k, " ".join([*words[: 20 + 6 * k], f"z{k}"])))
    assert as_counter(near_dup.near_duplicates(docs_of(rows), percent=percent)) == brute(rows, percent)


def test_rows_made_are_few(spark, docs_of, monkeypatch):
    """A family of N near texts, all under the threshold: cells hold some hundred rows each, and together a small share
    of the pairs."""
    rng, made = np.random.default_rng(9), []
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(600):
        own = list(base)
        for at in rng.choice(120, 9, replace=False):
            own[at] = f"x{rng.integers(10**6)}"
        rows.append((k, " ".join(own)))
    job = near_dup.NearDuplicates(docs_of(rows), "doc_id", "text", 80, 2)
    step = job.step

    def noted(df, name):
        out = step(df, name)
        if name in ("targets", "asks"):
            made.append(out.select("node", "blocks", "slices").collect())
        return out

    monkeypatch.setattr(job, "step", noted)
    assert as_counter(job.result()) == brute(rows)
    targets, asks = made
    total = sum(r.slices for r in targets) + sum(r.blocks for r in asks)
    assert total <= 3 * (len(targets) + len(asks)) * (1 + max(r.blocks for r in targets))


def test_percents_that_the_search_would_miss_are_refused(docs_of):
    with pytest.raises(ValueError, match="80 percent"):
        near_dup.near_duplicates(docs_of([(1, "x y")]), percent=60)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    for name, sql in oracles.ORACLES.items():
        df = queries.queries()[name](spark, DIR)
        result = con.execute(sql)
        cols = [x[0] for x in result.description]
        assert sorted(cols) == sorted(df.columns)
        assert Counter(map(tuple, result.fetchall())) == Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_resemblance_estimate():
    h = near_dup.WordHashes()
    words = [f"w{i}" for i in range(400)]
    a = near_dup.shingles(" ".join(words), h)
    b = near_dup.shingles(" ".join(words[:360] + [f"y{i}" for i in range(40)]), h)
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    gap = (near_dup.signature(a) != near_dup.signature(b)).mean()
    assert abs((1 - gap) - j) < 0.15
