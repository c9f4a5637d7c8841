import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spectrail.llm import lattice_lm, queries
from spectrail.llm.word_tables import LOWER, chunks, word_rows

from .conftest import AWKWARD

DIR = "/root/testdata/sf0.001"
PATH = queries.vocabulary("piece_bpe_32k.model")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.fixture(scope="module")
def own():
    return lattice_lm.lattice(PATH)


def plain_edges(own, word):
    """(from, to, piece ids) of each edge in order, by looking up every substring."""
    if not hasattr(own, "ids"):
        own.ids, own.longest = {p: i for i, p in enumerate(own.pieces)}, max(map(len, own.pieces))
    text = "▁" + word
    edges = [(i, j, [own.ids[text[i:j]]]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + own.longest) + 1) if text[i:j] in own.ids]
    return sorted(edges + [(i, i + 1, [own.n + b for b in c.encode()]) for i, c in enumerate(text) if c not in own.ids])


def plus(a, b):
    a, b = max(a, b), min(a, b)
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def plain_forward(own, word, log):
    edges, alpha = plain_edges(own, word), [0.0] + [-math.inf] * (len(word) + 1)
    for a, b, ids in edges:
        alpha[b] = plus(alpha[b], alpha[a] + sum(log[k] for k in ids))
    return alpha[-1]


def all_paths(edges, at, end):
    if at == end:
        yield []
    for a, b, ids in edges:
        if a == at:
            yield from (ids + rest for rest in all_paths(edges, b, end))


WORDS = ["the", "probability", "ß😀", "ＡＢ", "a", "▁x", "\x00", "naïve", "tiontionnt", "123,456.", "…"]


def test_forward_sums_all_segmentations(own):
    log = np.log(own.start)
    got = own.forward(WORDS, log)[0]
    for word, value in zip(WORDS, got, strict=True):
        assert value == pytest.approx(plain_forward(own, word, log), rel=1e-12)
        if len(word) < 8:
            paths = [sum(log[k] for k in ids) for ids in all_paths(plain_edges(own, word), 0, len(word) + 1)]
            assert value == pytest.approx(np.logaddexp.reduce(paths), rel=1e-12)


def test_expected_counts_are_shares_of_paths(own):
    log, counts = np.log(own.start), np.array([3, 1, 2])
    words = ["the", "ß😀", "aab"]
    got = own.backward(counts, own.forward(words, log)[1]) / lattice_lm.PARTS
    want = Counter()
    for word, c in zip(words, counts, strict=True):
        paths = list(all_paths(plain_edges(own, word), 0, len(word) + 1))
        p = np.exp([sum(log[k] for k in ids) for ids in paths])
        for ids, share in zip(paths, p / p.sum(), strict=True):
            for k in ids:
                want[k] += c * share
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-3) and got.sum() == pytest.approx(sum(want.values()), abs=1e-2)


def test_probabilities_add_up_to_one(own):
    assert own.start.sum() == pytest.approx(1) and (own.start > 0).all() and len(own.start) == own.n + 257


def test_long_words_take_time_in_proportion(own):
    log = np.log(own.start)
    one = own.forward(["thanbleshaningtionnt" * 5_000], log)[0][0]
    assert one < 0 and math.isfinite(one)
    assert [list(x) for x in lattice_lm.batches_of(["a" * 2_000_000, "b", "c" * 3])] == [[1, 2], [0]]


def brute(rows, own, rounds=lattice_lm.ROUNDS, prior=lattice_lm.PRIOR):
    train = [plain_words(t) for i, t in rows if not is_held(i)]
    counts, ends = Counter(w for ws in train for w in ws), len(train)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    weights = own.start
    lattices = {w: plain_edges(own, w) for w in counts}
    for _ in range(rounds):
        total, log = own.start * prior, np.log(weights).tolist()
        for w, c in counts.items():
            edges, size = [(a, b, ids, sum(log[k] for k in ids)) for a, b, ids in lattices[w]], len(w) + 2
            alpha, beta = [-math.inf] * size, [-math.inf] * size
            alpha[0] = beta[-1] = 0.0
            for a, b, _, own_log in edges:
                alpha[b] = plus(alpha[b], alpha[a] + own_log)
            for a, b, _, own_log in sorted(edges, key=lambda e: -e[1]):
                beta[a] = plus(beta[a], beta[b] + own_log)
            for a, b, ids, own_log in edges:
                for k in ids:
                    total[k] += c * math.exp(alpha[a] + own_log + beta[b] - alpha[-1])
        total[-1] += ends
        weights = total / total.sum()
    known, out, log = {}, [], np.log(weights).tolist()
    for i, text in rows:
        words = plain_words(text)
        for w in words:
            if w not in known:
                known[w] = plain_forward(own, w, log) / np.log(10)
        base = [*(counts[w] for w in words), ends]
        out.append((str(i), is_held(i), len(base), sum(c > 0 for c in base), n, sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in base), sum(known[w] for w in words) + np.log10(weights[-1])))
    return sorted(out, key=str)


def compare(got, want):
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    got, want = (sorted(x, key=lambda r: (r[0], r[2], round(r[5], 6))) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-5)  # expected counts are rounded


def test_scores_by_brute_force(spark, docs_of, own):
    rows = [*AWKWARD[:-2], (5, "long words " * 300), *((100 + i, t) for i, t in enumerate(["The Cat sat.", "the cat\tsat the\nmat", "ÀÉ the ÀÉ", " ", "▁ ▁▁", "x" * 200]))]
    compare(lattice_lm.score(docs_of(rows).repartition(3), PATH).collect(), brute(rows, own))
    assert lattice_lm.score(docs_of(rows).limit(0), PATH).count() == 0


def test_very_long_texts_and_nothing_to_learn_from(spark, docs_of, own):
    held = next(i for i in range(100) if is_held(i))
    got = lattice_lm.score(docs_of([(held, "long words " * 30_000)]), PATH).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (60_001, 0, 0, 0.0)
    assert got.score == pytest.approx((30_000 * own.forward(["long", "words"], np.log(own.start))[0].sum() + np.log(own.start[-1])) / np.log(10), rel=1e-9)


def test_query_by_brute_force(spark, own):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = queries.op11_lattice_likelihood(spark, DIR).collect()
    assert len(got) == len(rows)
    compare(got, brute(rows, own))
    # texts of the language are likelier than the same characters in another order
    rng = np.random.default_rng(0)
    ordinary = [w for w in plain_words(rows[0][1]) if len(w) > 4][:50]
    mixed = ["".join(rng.permutation(list(w))) for w in ordinary]
    assert own.forward(ordinary, np.log(own.start))[0].sum() > own.forward(mixed, np.log(own.start))[0].sum()


def test_chunks_hold_whole_texts(spark, docs_of):
    rows = [(i, f"w{i % 3} common {'x' * (i % 5)} common") for i in range(40)]
    table = docs_of(rows).repartition(1).selectExpr("doc_id as id", "cast(doc_id % 2 as int) as kind", "text")
    found = chunks(table, LOWER, size=100).cache()
    assert 5 < found.count() < 40 and sorted(i for r in found.collect() for i in r.ids) == list(range(40))
    sums = {r["word"]: (r["a"], r["b"]) for r in word_rows(found).groupBy("word").agg({"n0": "sum", "n1": "sum"}).toDF("word", "a", "b").collect()}
    want = {k: Counter(w for i, t in rows if i % 2 == k for w in t.split()) for k in (0, 1)}
    assert sums == {w: (want[0][w], want[1][w]) for w in want[0] | want[1]}
