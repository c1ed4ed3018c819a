"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector then goes down to its leaf, and the leaves
are stored in blocks of bounded size.  A query visits leaves best bin first: a priority queue
holds the branches not taken by their distance, and the next leaf is under the nearest one.
How many leaves a query visits is calibrated: on sample queries with exact answers the number
is widened until the wanted recall is reached.

Equal vectors are one entry with their smallest ids, so a vector that many rows share costs
one; each query meets only the blocks of its leaves, and a block returns a few candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.session import stage

# Bounds of the fit: sampled vectors, vectors per leaf of the sample, branches per node.
SAMPLE, LEAF, BRANCHES = 20_000, 100, 8
# Vectors of a block, and queries that meet a block at once.
BLOCK, ASKED = 1024, 256
# Parts that the rows of a leaf are dealt out to.
PARTS = 2
CALIBRATION, RECALL = 200, 0.97
_SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class KMeansTree:
    """Nodes as arrays: the centre of each node, its children, and its leaf number or -1."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF, branches: int = BRANCHES, seed: int = 11):
        self.rng, self.leaf, self.branches = np.random.default_rng(seed), leaf, branches
        self.centres, self.children, self.leaves, self.n_leaves = [], [], [], 0
        width = rows.shape[1] if rows.ndim == 2 else 0
        self._grow(rows, np.zeros(width))
        self.centres = np.array(self.centres)
        del self.rng

    def _grow(self, rows: np.ndarray, centre: np.ndarray) -> int:
        node = len(self.children)
        self.centres.append(centre)
        self.children.append([])
        self.leaves.append(-1)
        parts = self._split(rows) if len(rows) > self.leaf else None
        if parts is None:
            self.leaves[node], self.n_leaves = self.n_leaves, self.n_leaves + 1
        else:
            self.children[node] = [self._grow(part, part.mean(axis=0)) for part in parts]
        return node

    def _split(self, rows: np.ndarray) -> list[np.ndarray] | None:
        centres = rows[self.rng.choice(len(rows), min(self.branches, len(rows)), replace=False)].copy()
        for _ in range(12):
            near = self._distance(rows, centres).argmin(axis=1)
            for i in range(len(centres)):
                if (near == i).any():
                    centres[i] = rows[near == i].mean(axis=0)
        near = self._distance(rows, centres).argmin(axis=1)
        parts = [rows[near == i] for i in range(len(centres)) if (near == i).any()]
        return parts if len(parts) > 1 else None

    @staticmethod
    def _distance(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node."""
        out, waiting = np.zeros(len(rows), dtype=np.int64), [(0, np.arange(len(rows)))]
        while waiting:
            node, index = waiting.pop()
            if not len(index):
                continue
            if self.leaves[node] >= 0:
                out[index] = self.leaves[node]
                continue
            children = self.children[node]
            near = self._distance(rows[index], self.centres[children]).argmin(axis=1)
            waiting += [(child, index[near == i]) for i, child in enumerate(children)]
        return out

    def visit(self, row: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves of a best-bin-first walk."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < leaves:
            _, node = heapq.heappop(queue)
            while self.leaves[node] < 0:
                children = self.children[node]
                gaps = ((self.centres[children] - row) ** 2).sum(axis=1)
                order = gaps.argsort(kind="stable")
                for i in order[1:]:
                    heapq.heappush(queue, (float(gaps[i]), children[i]))
                node = children[order[0]]
            found.append(self.leaves[node])
        return found


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def _cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines row by row, each from its own row alone, so equal rows get equal scores."""
    dots = (rows * query).sum(axis=1)
    return dots / (np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(axis=1)))


def bundles(rows: DataFrame, name: str, most: int) -> DataFrame:
    """(leaf, names, matrix): rows (leaf, name, v) of a leaf in bundles of at most ``most``.

    A leaf is dealt out to ``PARTS`` partitions and into bundles, which tasks share.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema[name].dataType.simpleString()
    arrow = pa.list_(pa.int64()) if kind.startswith("array") else pa.int64()
    salted = rows.select("leaf", name, "v", F.pmod(F.xxhash64(name), F.lit(PARTS)).cast("int").alias("salt"))

    def bundle(batches):
        held, key = [], None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([[n for _, n, _, _ in held]], pa.list_(arrow)),
                 pa.array([b"".join(v for _, _, v, _ in held)], pa.binary())], names=["leaf", name, "matrix"],
            )

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("leaf", name, "v", "salt"))):
                if held and ((row[0], row[3]) != key or len(held) == most):
                    yield out()
                    held = []
                key = (row[0], row[3])
                held.append(row)
        if held:
            yield out()

    dealt = salted.repartition(parts, "leaf", "salt").sortWithinPartitions("leaf", "salt")
    return dealt.mapInArrow(bundle, f"leaf long, {name} array<{kind}>, matrix binary")


class VectorIndex:
    """Index over (id, vector); ``search`` finds the ``k`` rows of largest cosine.

    Vectors that are null, zero, of another length than most, or that hold null or non-finite
    components take no part.  Ties go to the smaller id; repeated ids count as rows of their
    own but a query never finds its own id.  An empty table gives an empty result.
    """

    def __init__(self, vectors: DataFrame, id_column: str, vector_column: str, k: int = 5, sample: int = SAMPLE,
                 recall: float = RECALL, leaf: int = LEAF):
        self.spark, self.k, self.recall = vectors.sparkSession, k, recall
        vector = F.col(vector_column).cast("array<double>")
        rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("v")).filter("vec_id IS NOT NULL")
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine & F.exists("v", lambda x: x != 0))
        widths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"))
        common = widths.orderBy(F.desc("c"), "n").limit(1)
        rows = rows.join(F.broadcast(common.select("n")), F.size("v") == F.col("n"), "left_semi")
        # the k + 1 smallest ids of a vector are all that a list of k can need of it
        self.entries = self._entries(rows)
        chosen = self.entries.orderBy(F.xxhash64("ids"), "ids").limit(sample).select("v").toArrow()
        fitted = _matrix(chosen["v"].combine_chunks()) if chosen.num_rows else np.zeros((0, 1))
        self.tree = KMeansTree(unit(fitted), leaf)
        self.blocks = self._blocks()
        self.visits = self._calibrate() if chosen.num_rows else 1

    def _entries(self, rows: DataFrame) -> DataFrame:
        """One row per distinct vector: its bytes and its smallest ids."""
        k = self.k

        def pack(batches):
            for batch in batches:
                v = batch["v"].combine_chunks() if isinstance(batch["v"], pa.ChunkedArray) else batch["v"]
                data = [np.array(x, dtype="<f8").tobytes() for x in v.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(data, pa.binary())], names=["vec_id", "v"])

        packed = rows.mapInArrow(pack, "vec_id long, v binary")
        ranked = packed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
        # a vector that a third of all rows share is ranked in parts, then the parts together
        for keys in (["v", "salt"], ["v"]):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
            ranked = ranked.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")
        ids = F.array_sort(F.collect_list("vec_id"))
        return stage(ranked.groupBy("v").agg(ids.alias("ids")), "vector-entries")

    def _blocks(self) -> DataFrame:
        """(leaf, part, ids, matrix): the entries of a leaf in blocks of at most ``BLOCK``."""
        tree = self.spark.sparkContext.broadcast(self.tree)

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    leaf = tree.value.assign(unit(_matrix(batch["v"])))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), batch["ids"], batch["v"]], names=["leaf", "ids", "v"])

        placed = self.entries.mapInArrow(place, "leaf long, ids array<long>, v binary")
        return stage(bundles(placed, "ids", BLOCK), "vector-blocks")

    def _visiting(self, queries: DataFrame, leaves: int) -> DataFrame:
        """(leaf, q, v) for each leaf that a distinct query vector visits."""
        tree = self.spark.sparkContext.broadcast(self.tree)

        def walk(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                visited = [tree.value.visit(row, leaves) for row in unit(_matrix(batch["v"]))]
                counts = [len(x) for x in visited]
                take = np.repeat(np.arange(len(visited)), counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for v in visited for x in v], pa.int64()), batch["q"].take(pa.array(take)),
                     batch["v"].take(pa.array(take))], names=["leaf", "q", "v"],
                )

        return queries.mapInArrow(walk, "leaf long, q long, v binary")

    def _nearest(self, queries: DataFrame, leaves: int) -> DataFrame:
        """(q, vec_id, score): for each query vector the best entries with their ids.

        ``queries`` has (q, v), one row per distinct vector.  A block meets its queries in
        groups and returns, per query, the entries that may be among the best.
        """
        k = self.k
        met = self._visiting(queries, leaves)
        asked = bundles(met, "q", ASKED).toDF("leaf", "q", "asked")
        pairs = asked.join(self.blocks.hint("merge"), "leaf").select("q", "asked", "ids", "matrix")

        def score(batches):
            for batch in batches:
                # a row at a time: blocks are large
                for at in range(batch.num_rows):
                    q, asked, ids, matrix = (batch[c][at].as_py() for c in ("q", "asked", "ids", "matrix"))
                    query = np.frombuffer(asked, "<f8").reshape(len(q), -1)
                    rows = np.frombuffer(matrix, "<f8").reshape(len(ids), -1)
                    near = unit(query) @ unit(rows).T
                    out = []
                    for i, number in enumerate(q):
                        limit = np.partition(near[i], -k - 1)[-k - 1] if len(ids) > k + 1 else -2.0
                        best = np.flatnonzero(near[i] >= limit - _SLACK)
                        exact = _cosine(query[i], rows[best])
                        found = sorted(
                            (-s, vec_id) for s, j in zip(exact.tolist(), best.tolist()) for vec_id in ids[j]
                        )[:k + 1]
                        # of one more than asked, the query itself may be one
                        out += [(number, vec_id, -s) for s, vec_id in found]
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))],
                            names=["q", "vec_id", "score"],
                        )

        return pairs.mapInArrow(score, "q long, vec_id long, score double")

    def _top(self, found: DataFrame, least: str, own: str | None = None) -> DataFrame:
        rows = found.filter(F.col(own) != F.col("vec_id")) if own else found
        order = Window.partitionBy(least).orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (self.k if own else self.k + 1))

    def _calibrate(self) -> int:
        """The fewest leaf visits, doubled from two, that reach the recall on sampled entries."""
        asked = self.entries.orderBy(F.xxhash64("ids", F.lit(1)), "ids").limit(CALIBRATION)
        asked = stage(asked.select(F.col("ids")[0].alias("q"), "v"), "vector-calibration")
        total = self.tree.n_leaves
        exact = stage(self._top(self._nearest(asked, total), "q", "q").select("q", "vec_id"), "vector-exact")
        wanted, visits = exact.count(), 2
        while visits < total:
            got = self._top(self._nearest(asked, visits), "q", "q").select("q", "vec_id")
            if got.join(exact, ["q", "vec_id"], "left_semi").count() >= self.recall * wanted:
                return visits
            visits *= 2
        return total

    def search(self, queries: DataFrame, id_column: str, vector_column: str) -> DataFrame:
        """(query_id, rank, vec_id, score) of each query row's ``k`` nearest other rows."""
        vector = F.col(vector_column).cast("array<double>")
        rows = queries.select(F.col(id_column).cast("long").alias("query_id"), vector.alias("v"))
        rows = rows.filter("query_id IS NOT NULL AND v IS NOT NULL")

        def pack(batches):
            for batch in batches:
                data = [
                    None if not x or any(c is None for c in x) or not np.isfinite(x).all() or not any(x)
                    else np.array(x, dtype="<f8").tobytes() for x in batch["v"].to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([batch["query_id"], pa.array(data, pa.binary())], names=["query_id", "v"])

        width = 8 * self.tree.centres.shape[1]
        asked = stage(
            rows.mapInArrow(pack, "query_id long, v binary").filter(F.octet_length("v") == width), "vector-queries"
        )
        # rows that ask the same are answered once
        distinct = asked.groupBy("v").agg(F.min("query_id").alias("q"))
        best = self._top(self._nearest(distinct.select("q", "v"), self.visits), "q").drop("rank")
        named = asked.join(distinct, "v").select("query_id", "q")
        found = self._top(named.join(best, "q"), "query_id", "query_id")
        return found.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Each row whose id is divisible by ``every`` against all rows of the table."""
    index = VectorIndex(vectors, "vec_id", "embedding", k)
    return index.search(vectors.filter(F.col("vec_id") % every == 0), "vec_id", "embedding")
