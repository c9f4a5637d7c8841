"""Language-model scores by subword lattices: the probability of a text over all its segmentations into pieces.

A word, with the mark of a space before it, is a lattice: an edge for each piece of the vocabulary that stands there, and
for a character without a piece of its own an edge of its byte pieces. A word's probability is the sum over all paths, by
the forward recursion in logarithms; a text is its words and one end, so its probability is the product. Over all
sequences of pieces and one end the probabilities add up to 1.

The vocabulary is an existing one (a SentencePiece file) and is not trained. Its own scores weight the pieces before any
text is seen: log probabilities where the model is a unigram model; where it is a BPE model, whose scores are ranks, the
k-th piece has weight 1 / (k + 1). They count as `prior` occurrences beside those that expectation and maximisation
gathers over all distinct words of the training texts, with the words' counts, in `rounds` rounds. Expected counts are
added up in units of 2^-16, so sums don't depend on the order of tasks.

Each distinct word is scored once, wherever it occurs, and joined back by chunk of texts (word_tables.py).

Defined cases: a null or empty text has the end token only; a null id is in no held-out part, so it is learnt from;
repeated rows are counted and scored each; a text or word of any length is taken whole; with no training text all counts
are 0 and the vocabulary's scores alone remain; an empty table gives an empty result; other columns are neither read nor
returned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, released, small_batches
from .word_tables import LOWER, by_text, chunks, word_rows

SPACE = "▁"
#: Occurrences that the vocabulary's own scores count as, rounds of training, parts that an expected count is rounded to.
PRIOR, ROUNDS, PARTS = 20_000.0, 2, 1 << 16
#: Words and characters of a batch in a task.
BATCH, CHARS = 20_000, 1 << 20


class Lattice:
    """Pieces as a trie of sorted transitions, and the recursions over batches of words. The last weight is the end's."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        plain = [(p.piece, p.score) for p in model.pieces if p.type == 1 and p.piece]
        bytes_of = {int(p.piece[3:5], 16) for p in model.pieces if p.type == 6}
        self.pieces, scores = [p for p, _ in plain], np.array([s for _, s in plain])
        if len(bytes_of) not in (0, 256):
            raise ValueError("a vocabulary has all byte pieces or none")
        self.n = len(self.pieces)
        if model.trainer_spec.model_type == 1:
            start = np.exp(scores - scores.max())
        else:
            start = np.empty(self.n)
            start[np.argsort(-scores, kind="stable")] = 1 / (1 + np.arange(self.n))
        # bytes and the end have no scores of their own: each counts as the least piece
        self.start = np.concatenate([start, np.full(257, start.min())])
        self.start /= self.start.sum()
        nodes, ends = [{}], [-1]
        for i, piece in enumerate(self.pieces):
            at = 0
            for c in piece:
                if ord(c) not in nodes[at]:
                    nodes[at][ord(c)] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][ord(c)]
            ends[at] = i
        moves = sorted((at << 21 | c, to) for at, own in enumerate(nodes) for c, to in own.items())
        self.keys, self.to = (np.array([m[i] for m in moves], np.int64) for i in (0, 1))
        self.ends = np.array(ends)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        """Where the nodes of each word begin (a node before each character and one at its end), and the edges: from, to
        and piece, -1 - k for the k-th character without a piece; these as (code, bytes)."""
        codes = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        stop = np.repeat(np.cumsum(sizes), sizes)  # in characters
        shift = np.repeat(np.arange(len(words)), sizes)  # nodes are ahead of characters by one for each word before
        live, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found, single, step = [], np.zeros(len(codes), bool), 0
        while len(live):
            key = node << 21 | codes[live + step]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            live, node = live[hit], self.to[i[hit]]
            step += 1
            piece = self.ends[node]
            whole = piece >= 0
            at = live[whole]
            single[at] |= step == 1
            found.append((at + shift[at], at + shift[at] + step, piece[whole]))
            more = live + step < stop[live]
            live, node = live[more], node[more]
        alone = np.flatnonzero(~single)
        own, back = np.unique(codes[alone], return_inverse=True)
        found.append((alone + shift[alone], alone + shift[alone] + 1, -1 - back))
        unknown = [(int(c), chr(c).encode("utf-8", "surrogatepass")) for c in own]
        return first, *(np.concatenate(x) for x in zip(*found, strict=True)), unknown

    def _weights(self, piece: np.ndarray, unknown: list, log: np.ndarray) -> np.ndarray:
        spelt = np.array([sum(log[self.n + b] for b in data) for _, data in unknown] or [0.0])
        return np.where(piece >= 0, log[np.maximum(piece, 0)], spelt[np.maximum(-1 - piece, 0)])

    def forward(self, words: list[str], log: np.ndarray) -> tuple[np.ndarray, tuple]:
        """log P of each word, and what backward() needs."""
        first, a, b, piece, unknown = self.edges(words)
        weight, alpha = self._weights(piece, unknown, log), np.full(first[-1], -np.inf)
        alpha[first[:-1]] = 0.0
        begin = a - first[np.searchsorted(first, a, "right") - 1]
        for own in _runs(begin):
            alpha[b[own]] = np.logaddexp(alpha[b[own]], alpha[a[own]] + weight[own])
        return alpha[first[1:] - 1], (first, a, b, piece, unknown, weight, alpha)

    def backward(self, counts: np.ndarray, held: tuple) -> np.ndarray:
        """Expected occurrences of each piece and byte in words with these counts, in PARTS."""
        first, a, b, piece, unknown, weight, alpha = held
        word = np.searchsorted(first, a, "right") - 1
        beta, end = np.full(first[-1], -np.inf), first[1:] - 1
        beta[end] = 0.0
        for own in reversed(_runs(b - first[word])):
            beta[a[own]] = np.logaddexp(beta[a[own]], beta[b[own]] + weight[own])
        share = np.rint(np.exp(alpha[a] + weight + beta[b] - alpha[end][word]) * counts[word] * PARTS).astype(np.int64)
        total, plain = np.zeros(self.n + 257, np.int64), piece >= 0
        np.add.at(total, piece[plain], share[plain])
        spelt = np.zeros(len(unknown) + 1, np.int64)
        np.add.at(spelt, -1 - piece[~plain], share[~plain])
        for (_, data), s in zip(unknown, spelt, strict=False):
            for x in data:
                total[self.n + x] += s
        return total


def _runs(values: np.ndarray) -> list[np.ndarray]:
    """The places of each value, in order of the values."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(order) else []


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def batches_of(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of like length, so many that a batch's edges are bounded but for a word that is longer itself."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    order = np.argsort(sizes, kind="stable")
    while len(order):
        n = max(1, min(BATCH, int(np.searchsorted(np.cumsum(sizes[order[:BATCH]]), CHARS, "right"))))
        yield order[:n]
        order = order[n:]


def expected(words: DataFrame, path: str, weights: np.ndarray) -> np.ndarray:
    """Expected occurrences, in PARTS, of each piece over rows (word, c). At most a row for each piece and task is summed."""
    shared = words.sparkSession.sparkContext.broadcast(np.log(weights))

    @released
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = lattice(path), 0
        for b in batches:
            texts, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
            for at in batches_of(texts):
                total = total + own.backward(counts[at], own.forward([texts[i] for i in at], shared.value)[1])
        if not np.isscalar(total):
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(total[kept], pa.int64())], ["piece", "n"])

    found = words.select("word", "c").mapInArrow(part, "piece int, n long").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    total = np.zeros(len(weights))
    for r in found.collect():  # as many rows as the vocabulary has pieces, at most
        total[r["piece"]] = float(r["n"]) / PARTS
    return total


def train(words: DataFrame, path: str, ends: int, prior: float = PRIOR, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of pieces, bytes and the end from rows (word, c) of the training texts and how many texts these are."""
    own = lattice(path)
    weights, least = own.start, own.start * prior
    for _ in range(rounds):
        total = expected(words, path, weights) + least
        total[-1] += ends
        weights = total / total.sum()
    return weights


def word_scores(words: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """(word, c, log10p) of rows (word, c)."""
    shared = words.sparkSession.sparkContext.broadcast(np.log(weights))

    @released
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for b in batches:
            texts, log = b.column(0).to_pylist(), np.empty(b.num_rows)
            for at in batches_of(texts):
                log[at] = own.forward([texts[i] for i in at], shared.value)[0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(log / np.log(10))], ["word", "c", "log10p"])

    return words.select("word", "c").mapInArrow(scored, "word string, c long, log10p double")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", prior: float = PRIOR, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known (those met in training), train_tokens, base_score (words and the end by their
    own smoothed counts) and score (log10 of the lattice's probability) of each document, from those not held out."""
    kind = F.when(held_out(F.col(key)), 1).otherwise(0)
    rows = documents.select(F.col(key).cast("long").alias("id"), kind.alias("kind"), F.col(text).alias("text"))
    ends = rows.where("kind = 0").count()
    chunked = materialize(chunks(rows, LOWER), "chunks")
    words = materialize(word_rows(chunked).groupBy("word").agg(F.sum("n0").alias("c")), "words")
    known = words.where("c > 0")
    n, v = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    with small_batches(documents.sparkSession, 100_000):
        weights = train(known, path, ends, prior, rounds)
    scored = materialize(word_scores(words, path, weights), "scored")
    discard(words)
    values = word_rows(chunked).select("chunk", "at", "word").join(scored, "word").select("chunk", "at", "c", "log10p")
    log_end, of_all = float(np.log10(weights[-1])), n + 0.5 * (v + 1)

    def of_texts(sizes: np.ndarray, at: np.ndarray, arrays: list[np.ndarray]) -> list:
        c, log = (np.append(x, end) for x, end in zip(arrays, (ends, log_end), strict=True)) if arrays[0].size else (np.array([ends]), np.array([log_end]))
        stop = np.cumsum(sizes)
        at = np.insert(at, stop, len(c) - 1)  # each text's end
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        sums = lambda x: np.add.reduceat(x[at], begin)
        return [sizes + np.int64(1), sums((c > 0).astype(np.int64)), sums(np.log10((c + 0.5) / of_all)), sums(log)]

    found = materialize(by_text(chunked, values, "doc_id long, n_tokens long, n_known long, base_score double, score double", of_texts), "texts")
    discard(scored)
    discard(chunked)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
