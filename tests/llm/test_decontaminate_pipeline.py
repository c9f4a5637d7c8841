import tracemalloc

import numpy as np

import corpus_pipeline
from spectrail.llm import decontaminate, piece_codec, queries, secret_scan, toxicity
from spectrail.llm.queries import vocabulary

from . import test_near_dup
from .conftest import AWKWARD

DIR = "/root/testdata/sf0.001"


def slow_tiles(doc, item, least):
    """Greedy string tiling word by word."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_i:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return tiles
        n, i, j = -best[0], best[1], best[2]
        tiles.append((i, j, n))
        used_d |= set(range(i, i + n))
        used_i |= set(range(j, j + n))


def words(text):
    return (text or "").encode().translate(decontaminate.NORMAL).split()


def slow_leaks(docs, items, least=5, coverage=0.8):
    found = []
    for d, t in docs:
        for k, s in sorted(set(items), key=str):
            w = words(s)
            if w:
                tiles = slow_tiles(words(t), w, min(least, len(w)))
                n = sum(x[2] for x in tiles)
                if n >= coverage * len(w) - 1e-9:
                    found.append((str(d), str(k), len(w), n, tuple(tiles)))
    return sorted(found)


def case():
    rng = np.random.default_rng(0)
    v = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(v, 20))) for i in range(6)] + [(6, "short item"), (7, None), (8, "!!"), (9, "a a a a a a a a"), (9, "a a a a a a a a"), (None, " ".join(rng.choice(v, 12)))]
    docs = []
    for k in range(40):
        own = list(rng.choice(v, 30))
        item = items[int(rng.integers(6))][1].split()
        if k % 3 == 0:
            own[10:10] = item
        elif k % 3 == 1:  # in another order, with some words changed
            own[5:5] = item[12:] + ["z"] + item[:12]
        if k % 5 == 0:
            own += ["Short", "ITEM!"]
        docs.append((k, " ".join(map(str, own))))
    return [*docs, (90, "a " * 40), (91, "a a a a a b a a a"), *((i and i + 1000, t) for i, t in AWKWARD[:6])], items


def test_tiling_by_brute_force(spark, docs_of):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (32 << 20, 200):  # one block of items, or many
        rows = decontaminate.find_leaks(docs_of(docs), bench, block_bytes=block).collect()
        got = sorted((str(r.doc_id), str(r.item_id), r.item_words, r.covered_words, tuple(tuple(t) for t in r.tiles)) for r in rows)
        assert got == slow_leaks(docs, items)
    assert any(len(x[4]) > 1 for x in got)
    kept = decontaminate.without_leaks(docs_of(docs), bench)
    bad = {x[0] for x in got}
    assert kept.columns == docs_of(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in bad)


def test_tiling_of_repetitive_texts():
    """Few words, so that most places match: the same tiles as word by word, and memory that doesn't grow with the pairs."""
    rng = np.random.default_rng(5)
    for _ in range(150):
        v = [f"w{i}" for i in range(rng.integers(1, 5))]
        doc, item = (list(map(str, rng.choice(v, rng.integers(1, n)))) for n in (25, 14))
        least = min(int(rng.integers(1, 5)), len(item))
        got = decontaminate.Index([(1, " ".join(item))], least, 1e-9).leaks(" ".join(doc))
        assert ([tuple(t) for t in got[0][2]] if got else []) == slow_tiles(doc, item, least)
    index = decontaminate.Index([(1, "a " * 200)], 5, 0.8)
    tracemalloc.start()
    assert index.leaks("a " * 20_000)[0][1:] == (200, [(0, 0, 200)])
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_blocks_hold_no_more_than_they_may(spark):
    bench = spark.createDataFrame([(i, "w " * (i % 50)) for i in range(300)], "item_id long, text string")
    found = [items for _, items in decontaminate.blocks(bench, block_bytes=2000)]
    assert sorted(i for b in found for i, _ in b) == list(range(300)) and len(found) > 5
    assert all(sum(64 + len(t) for _, t in b) <= 2000 or len(b) < 3 for b in found)


def test_empty_tables(spark, docs_of):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_leaks(docs_of(docs), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs_of(docs).limit(0), bench).count() == 0
    assert decontaminate.without_leaks(docs_of(docs), bench.limit(0)).count() == len(docs)


def test_op10_query(spark):
    """All documents and items; only those that share no five words are passed over."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.item_words, r.covered_words, r.n_tiles) for r in queries.op10_string_tiling(spark, DIR).collect()}
    runs = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {}
    for d, t in docs:
        own = runs(words(t))
        for i, w in items:
            if len(w) >= 5 and (shared := runs(w) & own):
                covered = {k + n for k in range(len(w) - 4) if tuple(w[k : k + 5]) in shared for n in range(5)}
                tiles = fast_tiles(words(t), w) if len(covered) >= 0.8 * len(w) - 1e-9 else []
                if (n := sum(x[2] for x in tiles)) >= 0.8 * len(w) - 1e-9:
                    want[d, i] = (len(w), n, len(tiles))
    assert want and want == got


def fast_tiles(doc, item, least=5):
    """slow_tiles(), but that places which don't match cost nothing."""
    places = {}
    for j, w in enumerate(item):
        places.setdefault(w, []).append(j)
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = None
        for i, w in enumerate(doc):
            for j in places.get(w, ()):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_i:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return tiles
        n, i, j = -best[0], best[1], best[2]
        tiles.append((i, j, n))
        used_d |= set(range(i, i + n))
        used_i |= set(range(j, j + n))


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Model(model, toxicity.Settings())
    rows = [(i, t) for i, t in rows if scorer.score(t) < 0.3]
    firsts = {i for i, _, _, k in test_near_dup.brute(rows, size=5) if k}
    rows = [(i, t) for i, t in rows if i in firsts]
    index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()], 5, 0.8)
    rows = [(i, t) for i, t in rows if not index.leaks(t)]
    table = secret_scan.train(secret_scan.labelled_samples(spark))
    own = piece_codec.Codec(vocabulary("piece_bpe_32k.model"))
    from .test_scans import all_spans

    def plain(text):
        out, at = "", 0
        for a, b in [tuple(map(int, s.split(":")[1:])) for s in all_spans(text, table).split(",") if s]:
            out, at = out + (text[at:a] + "[SECRET]") * (a >= at), max(at, b)
        return out + text[at:]

    want = {i: own.encode(plain(t))[0].tolist() for i, t in rows}
    got = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)


def test_stages_take_awkward_tables(spark, docs_of, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, None)], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "encoding"] and corpus_pipeline.ORACLE_SQL is None
    for docs in (docs_of([*AWKWARD, (70, "ONE two three four five six"), (71, 'token="abcdefgh12"')]), docs_of(AWKWARD).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "encoding":
                assert out.columns == docs.columns
            if docs.isEmpty():
                assert out.isEmpty()
            elif name == "decontamination":
                assert out.where("doc_id = 70").isEmpty()
            elif name == "secrets":
                r = out.where("doc_id = 71").first()
                assert r.text == '[SECRET]"' and r.n_chars == 9


