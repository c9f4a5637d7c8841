"""Near-duplicates of word shingles by a multi-index Hamming join of b-bit MinHash signatures.

1. Each text becomes its set of distinct 2-word shingles. Texts of equal sets form a class; a class is a node.
2. A node's signature has CHUNKS * WIDTH minima, of which 16 bits are kept (b-bit MinHash, Li and Koenig, 2010). The
   distance of two signatures is the number of places that differ. By the pigeonhole principle, of the chunks of two
   signatures at most LIMIT = 2 * CHUNKS - 1 apart, one has at most one error; enumerating that error's place as a mask
   gives CHUNKS * WIDTH keys, of which two such signatures share at least one. So every pair within LIMIT is met. A pair
   of similarity 0.8 is within LIMIT but for a chance of about 1.1e-5, that of more than 35 of 90 places at 0.2 each.
3. No pairs are emitted within a key's group. First, each node is tried against one node only: of the smallest nodes of
   its groups, the one it meets most often. Confirmed pairs make a forest of trees; all pairs, confirmed or not, make a
   coarser forest of locales.
4. Groups that still hold more than one tree are then searched exhaustively between trees: a node outside its group's
   largest tree asks each locale that the group has nodes of. All nodes of the locale whose sets are of a size that can
   be similar are compared with it on their full sets, in cells of about BLOCK nodes and SLICE askers, or fewer long
   ones, through an index of the block's shingles. A cell gives the links that join trees and no others. So no pair of
   different trees that meets in any group goes untested, however large the group. A locale's N nodes and A askers make
   about N * A * (1 / SLICE + 1 / BLOCK) rows, a small share of their N * A pairs, in cells of a few hundred rows each.
5. Pairs are confirmed on the full sets: 100 * intersection >= PERCENT * union. Trees joined by confirmed pairs form
   components, by alternating large-star and small-star steps (Kiveris et al., 2014).

Shingles are compared by 64-bit fingerprints, sets by 128-bit ones.

Defined cases: texts without words, empty and null texts have no shingles, are linked with nothing and are their own
component; a text of one word has that word as its shingle; texts of any length are taken whole; a null id is never the
smallest of a component that has other ids, and the component of null ids alone is null; rows that repeat an id each
get their row, by their own text; ties between leaders go to the smaller node; an empty table gives an empty result;
other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import WordHashes, discard, materialize, released

PERCENT = 80
CHUNKS, WIDTH = 18, 5
PLACES, LIMIT = CHUNKS * WIDTH, 2 * CHUNKS - 1
#: What a cell holds: nodes, askers, and shingles of either, on average.
BLOCK, SLICE, GRAMS = 256, 384, 1 << 18
_random = np.random.default_rng(20240607)
FACTORS = _random.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEEDS = _random.integers(0, 2**63, PLACES, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
MASK_SEEDS = _random.integers(0, 2**63, CHUNKS * WIDTH, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, hashes: WordHashes, size: int = 2) -> np.ndarray:
    """Sorted fingerprints of the distinct shingles of a text; of its whole word sequence where that is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = mix(out * ODD + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each of PLACES hash functions."""
    least = np.full(PLACES, np.uint64(2**64 - 1))
    for part in np.array_split(grams, -(-len(grams) // 4096)):
        np.minimum(least, mix(part[:, None] * FACTORS + SEEDS).min(axis=0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


@released
def _profile(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        n, digest, sig = [], [], []
        for x in b.column(1):
            grams = shingles(x.as_py(), hashes, size)
            n.append(len(grams))
            digest.append(xxhash.xxh3_128_digest(grams.tobytes()) if n[-1] else None)
            sig.append(signature(grams).tobytes() if n[-1] else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "digest", "sig"])


@released
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and masked chunk."""
    kept = [np.array([c * WIDTH + i for i in range(WIDTH) if i != m]) for c in range(CHUNKS) for m in range(WIDTH)]
    for b in batches:
        for at in range(0, b.num_rows, 4000):
            nodes = b.column(0).slice(at, 4000).to_numpy(zero_copy_only=False)
            sig = _matrix(b.column(1).slice(at, 4000)).astype(np.uint64)
            keys = np.empty((len(nodes), len(kept)), np.uint64)
            for k, places in enumerate(kept):
                packed = sig[:, places[0]]
                for p in places[1:]:
                    packed = (packed << np.uint64(16)) | sig[:, p]
                keys[:, k] = mix(packed + MASK_SEEDS[k])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(nodes, len(kept)))], ["key", "node"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PLACES)


@released
def _cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that join trees, from rows sorted by cell: locale, part, block, slice, query, node, tree, grams."""

    def links(rows: list[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        t = pa.Table.from_batches(rows)
        query, tree = t["query"].to_numpy(), t["tree"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
        own = np.flatnonzero(query == 0)
        if not len(own):
            return
        size = np.array([len(sets[i]) for i in own])
        grams, of = np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), size)
        order = np.argsort(grams, kind="stable")
        values, starts = np.unique(grams[order], return_index=True)
        starts, of = np.append(starts, len(grams)), of[order]
        joined = {int(x): int(x) for x in tree}

        def root(x: int) -> int:
            while joined[x] != x:
                joined[x] = x = joined[joined[x]]
            return x

        for q in np.flatnonzero(query > 0):
            mine = sets[q]
            at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
            at = at[values[at] == mine]
            counts = starts[at + 1] - starts[at]
            hit = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(at) else at
            both = np.bincount(of[hit], minlength=len(own))
            near = 100 * both >= percent * (size + len(mine) - both)
            for other in np.unique(tree[own[near & (tree[own] != tree[q])]]).tolist():
                if (x := root(int(tree[q]))) != (y := root(other)):
                    joined[x] = y
                    yield int(tree[q]), other

    def out(found: list[tuple]) -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    now, held, found = None, [], []
    for batch in batches:
        cell = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        cuts = np.flatnonzero(reduce(np.logical_or, [c[1:] != c[:-1] for c in cell])) + 1 if batch.num_rows else []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a == b:
                continue
            this = tuple(c[a] for c in cell)
            if this != now and held:
                found += links(held)
                held = []
            now = this
            held.append(batch.slice(a, b - a))
        if len(found) > 10_000:
            yield out(found)
            found = []
    if held:
        found += links(held)
    yield out(found)


@released
def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], ["a", "b"])


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches. Alternates large and small stars."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        old = edges
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("v"), "m").where("v != m").union(down).toDF("a", "b").distinct()
        edges = materialize(small, "edges")
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.toDF("node", "root")
        before = now


class NearDuplicates:
    """The job over one table of documents."""

    def __init__(self, documents: DataFrame, key: str, text: str, percent: int, size: int) -> None:
        if percent < PERCENT:
            raise ValueError(f"the search for candidates meets pairs of {PERCENT} percent or more only")
        self.docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        self.percent, self.size = percent, size
        self.profiles = materialize(self.docs.mapInArrow(partial(_profile, size=size), "doc_id long, n long, digest binary, sig binary"), "profiles")
        same = self.profiles.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        self.nodes = materialize(same.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.steps: list[DataFrame] = []

    def step(self, df: DataFrame, name: str) -> DataFrame:
        """A table that only the search for components needs."""
        self.steps.append(materialize(df, name))
        return self.steps[-1]

    def postings(self) -> DataFrame:
        return self.nodes.select("node", "sig").mapInArrow(_keys, "key long, node long")

    def grams(self, wanted: DataFrame) -> DataFrame:
        """(node, grams) of the wanted nodes, from their texts. A bitmap of bounded size spares the other texts."""
        wanted = wanted.distinct().join(self.nodes.select("node", "digest", "rep"), "node")
        bits = min(1 << 26, max(1 << 16, 1 << (16 * max(1, wanted.count())).bit_length()))
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
        words = wanted.select(slot("rep").alias("s")).groupBy(F.expr("s div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("v")).toPandas()
        bitmap = np.zeros(bits // 32, np.uint32)
        bitmap[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint32)
        shared, size = self.docs.sparkSession.sparkContext.broadcast(bitmap), self.size

        @released
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, held = WordHashes(), shared.value
            for b in batches:
                s = b.column(0).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero((held[s // 32] >> (s % 32).astype(np.uint32)) & np.uint32(1))
                own = [g for i in keep if len(g := shingles(b.column(1)[int(i)].as_py(), hashes, size))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in own], pa.binary()), pa.array([g.tobytes() for g in own], pa.binary())], ["digest", "grams"])

        found = self.docs.select(slot("doc_id").alias("s"), "text").mapInArrow(sets, "digest binary, grams binary")
        found = found.groupBy("digest").agg(F.first("grams").alias("grams"))
        return self.step(wanted.select("node", "digest").join(found, "digest").select("node", "grams"), "grams")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        pairs = self.step(pairs.select("a", "b"), "pairs")
        sets = self.grams(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        left = pairs.join(sets.toDF("a", "x"), "a")
        return self.step(left.join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(partial(_confirm, percent=self.percent), "a long, b long"), "links")

    def _roots(self, links: DataFrame) -> DataFrame:
        """(node, root) from links (a, b) of which each node has one at most, to a smaller node: jump to the root."""
        roots = links.toDF("node", "root")
        while True:
            up = roots.toDF("root", "_up")
            joined = roots.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved"))
            roots = self.step(joined, "roots")
            if roots.where("moved").isEmpty():
                return roots.select("node", "root")
            roots = roots.select("node", "root")

    def trees(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Members (key, node) of groups of two or more; (node, locale) of these nodes; (node, root) of linked nodes."""
        shared = self.postings().groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).where("leader < _last").select("key", "leader")
        members = self.step(self.postings().join(shared, "key").select("key", "node", "leader"), "members")
        met = members.where("node != leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("times"))
        best = met.groupBy("node").agg(F.max(F.struct("times", (-F.col("leader")).alias("l"))).alias("best"))
        tried = self.step(best.select(F.col("node").alias("a"), (-F.col("best.l")).alias("b")), "tried")
        return members.select("key", "node"), self._roots(tried), self._roots(self.confirmed(tried))

    def across(self, members: DataFrame, locales: DataFrame, roots: DataFrame) -> DataFrame:
        """(a, b): trees that a link joins."""
        own = lambda name: F.coalesce(name, "node").alias(name)
        placed = members.join(roots.toDF("node", "tree"), "node", "left").select("key", "node", own("tree"))
        counts = placed.groupBy("key", "tree").agg(F.count(F.lit(1)).alias("c"))
        mixed = counts.groupBy("key").agg(F.max(F.struct("c", "tree")).alias("m"), F.sum("c").alias("all")).where("all > m.c")
        mixed = self.step(placed.join(mixed.select("key", F.col("m.tree").alias("main")), "key").join(locales.toDF("node", "locale"), "node", "left").select("key", "node", "tree", "main", own("locale")), "mixed")
        asked = mixed.where("tree != main").select("key", "node", "tree").join(mixed.select("key", "locale").distinct(), "key").select("locale", "node", "tree").distinct()
        asked = self.step(asked, "asked")
        # every node of a locale that is asked: those with a locale, and the locale itself, which has no other one. Within
        # a locale, nodes are parted by size: classes of sizes that grow by 1 / (percent / 100), so that a node can only be
        # similar to those of its own and the two next classes. Counts come before the joins by place, so that a large
        # place's rows can be split
        n = self.nodes.select("node", "n")
        sized = F.floor(F.ln("n") / max(math.log(100 / self.percent), 1e-6)).cast("int")
        found = locales.toDF("node", "locale").union(asked.select(F.col("locale").alias("node"), "locale").distinct())
        there = self.step(found.join(n, "node").select("locale", "node", sized.alias("part"), "n"), "there")
        held = there.groupBy("locale", "part").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("nodes_n"))
        asks = asked.join(n, "node").select("locale", "node", "tree", "n", F.explode(F.array(*(sized + i for i in (-1, 0, 1)))).alias("part"))
        touched = asks.groupBy("locale", "part").agg(F.count(F.lit(1)).alias("askers"), F.sum("n").alias("asked_n"))
        parts = lambda count, most, total: F.expr(f"cast(ceil(greatest({count} / {most}, {total} / {GRAMS})) as int)")
        sizes = held.join(touched, ["locale", "part"]).select("locale", "part", parts("nodes", BLOCK, "nodes_n").alias("blocks"), parts("askers", SLICE, "asked_n").alias("slices"))
        sizes = self.step(sizes, "sizes")
        there = self.step(there.join(sizes, ["locale", "part"]).join(roots.toDF("node", "tree"), "node", "left").select("locale", "part", "node", own("tree"), "blocks", "slices"), "targets")
        asks = self.step(asks.join(sizes, ["locale", "part"]).select("locale", "part", "node", "tree", "blocks", "slices"), "asks")
        sets = self.grams(there.select("node").union(asks.select("node")))
        at = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        place = ["locale", "part", "block", "slice"]
        targets = there.join(sets, "node").withColumn("block", at("blocks")).select("locale", "part", "block", every("slices").alias("slice"), F.lit(0).alias("query"), "node", "tree", "grams")
        queries = asks.join(sets, "node").withColumn("slice", at("slices")).select("locale", "part", every("blocks").alias("block"), "slice", F.lit(1).alias("query"), "node", "tree", "grams")
        cells = targets.unionByName(queries).repartition(*place).sortWithinPartitions(*place)
        return self.step(cells.mapInArrow(partial(_cells, percent=self.percent), "a long, b long").distinct(), "across")

    def components(self) -> DataFrame:
        """(node, root) of all nodes that are linked with another."""
        members, locales, roots = self.trees()
        links = stars(self.across(members, locales, roots))
        moved = roots.join(links.toDF("root", "_to"), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        found = materialize(moved.union(links).groupBy("node").agg(F.min("root").alias("root")), "roots")
        for table in [*self.steps, links]:
            discard(table)
        self.steps = [found]
        return found

    def close(self) -> None:
        """Delete what nothing reads any more once a result is written."""
        for table in [self.profiles, self.nodes, *self.steps]:
            discard(table)

    def classes(self) -> DataFrame:
        """(digest, root, component_id) of each class of equal sets."""
        nodes, found = self.nodes.select("node", "digest", "rep"), self.components()
        # a root stands for itself; the component's id is the smallest of its nodes' smallest ids
        whole = found.union(found.select("root", F.col("root"))).distinct()
        ids = whole.join(nodes, "node").groupBy("root").agg(F.min("rep").alias("id"))
        return whole.join(ids, "root").join(nodes, "node", "right").select("digest", F.coalesce("root", "node").alias("root"), F.coalesce("id", "rep").alias("component_id"))

    def firsts(self) -> DataFrame:
        """(first_id, first_digest): of each component with words, the smallest id, null after all others, and its set."""
        rows = self.classes().join(self.nodes.select("digest", "rep"), "digest")
        first = rows.groupBy("root").agg(F.min(F.struct(F.isnull("rep").alias("none"), "rep", "digest")).alias("f"))
        return materialize(first.select(F.col("f.rep").alias("first_id"), F.col("f.digest").alias("first_digest")), "firsts")

    def result(self) -> DataFrame:
        by_digest = self.classes().select("digest", "component_id")
        rows = self.profiles.select("doc_id", "n", "digest").join(by_digest, "digest", "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (doc_id = component_id)."""
    job = NearDuplicates(documents, key, text, percent, size)
    result = materialize(job.result(), "components")
    job.close()
    return result


def first_of_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = 2) -> DataFrame:
    """The documents, with all their columns, of which one row of each component stays: that with the smallest id.

    A row is known by its id; where ids are null or repeat, by its id and its set. Of rows alike in both stays that with
    the smallest text, then the smallest JSON form of all columns. Each row without words stays. size: words of a shingle.
    """
    job = NearDuplicates(documents, key, text, percent, size)
    firsts, own = job.firsts(), documents[key].cast("long")
    unclear = materialize(job.profiles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "unclear")
    kept = firsts.select(F.col("first_id").alias("doc_id")).union(job.profiles.where("n = 0").select("doc_id")).where("doc_id is not null")
    kept = materialize(kept.join(unclear, "doc_id", "left_anti"), "kept")
    job.close()
    rows = documents.join(kept, own == kept["doc_id"], "left_semi")
    if unclear.isEmpty():
        return rows
    column, extra = documents.columns.index(text), "_digest"
    while extra in documents.columns:
        extra += "_"

    @released
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(x.as_py() or "", hashes, size) for x in b.column(column)]
            yield b.append_column(extra, pa.array([xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in sets], pa.binary()))

    schema = StructType([*documents.schema.fields, StructField(extra, BinaryType())])
    marked = documents.join(unclear, own.eqNullSafe(unclear["doc_id"]), "left_semi").mapInArrow(digests, schema)
    same = marked.join(firsts, (marked[extra] == firsts["first_digest"]) & marked[key].cast("long").eqNullSafe(firsts["first_id"]), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    first = same.groupBy(extra).agg(F.min_by(whole, F.struct(F.col(text), F.to_json(whole))).alias("_row")).select("_row")
    return rows.union(first.select("_row.*")).union(marked.where(F.col(extra).isNull()).drop(extra))
