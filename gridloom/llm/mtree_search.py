"""Exact top-k inner-product search with M-trees.

Inner products become distances by one more coordinate: with x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) the squared
distance is |q|^2 + M^2 - 2 q.x, so the nearest neighbours are the largest products. Each shard of the candidates has
an M-tree of paged nodes; an entry stores its routing vector, its covering radius and its distance to the parent's
routing vector. The search takes nodes best-first by their least possible distance and drops an entry without
computing its distance where the stored parent distance and the triangle inequality already rule it out. Scores are
integers and exact; bounds are widened by a relative slack so that rounding and ties lose nothing.

Candidates are dealt to shards of bounded size by a hash of vec_id (equal vectors spread evenly). A stated query set
visits every shard: query rows are copied once per shard and stream through the task that holds the shard's tree, so
a task's memory is one tree and one batch of queries, and k rows per query and shard are merged at the end.

Defined results: vectors that are null or have a null or non-finite component, and rows with a null vec_id, take no
part; vectors shorter than the longest are continued with zeros; equal scores go by the smaller vec_id; rows with the
query's own vec_id are not its candidates, and a repeated query row is answered once; fewer than k candidates give
fewer rows; an empty table gives no rows; a component beyond 2^26 in size raises an error (a product could overflow);
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a page.
PAGE = 128
#: Candidates of a shard at most, and the size from which small tables use several shards.
SHARD, LEAST = 16_384, 2_048
SLACK = 1e-9
#: Queries searched in step.
QUERIES = 1024


class Node:
    """A page: child entries (or the leaf's vectors) with radii and distances to this node's routing vector."""

    __slots__ = ("children", "rows", "centres", "radii", "parent", "numbers")

    def __init__(self, children: list[Node] | None, rows: np.ndarray | None, centres: np.ndarray | None, radii: np.ndarray | None, parent: np.ndarray) -> None:
        self.children, self.rows, self.centres, self.radii, self.parent = children, rows, centres, radii, parent
        self.numbers: np.ndarray | None = None  # of the children, while a search runs


class MTree:
    """Bulk-loaded M-tree over integer vectors with ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.int64)
        self.exact = self.vectors.astype(np.float64)  # products below 2^53 are exact in double; others are redone in integers
        square = (self.exact**2).sum(axis=1)
        self.bound = float(square.max()) if len(ids) else 0.0
        self.points = np.column_stack((self.exact, np.sqrt(np.maximum(self.bound - square, 0.0))))
        self.small = self.bound < 2.0**52
        self.centre = self.points[0] if len(ids) else None
        self.root = self._build(np.arange(len(ids)), self.centre) if len(ids) else None

    def _distance(self, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.points[rows] - centre) ** 2).sum(axis=1), 0.0))

    def _build(self, rows: np.ndarray, centre: np.ndarray) -> Node:
        far = self._distance(rows, centre)
        if len(rows) <= PAGE:
            return Node(None, rows, None, None, far)
        groups = self._split(rows, far)
        centres = []
        for g in groups:  # the vector nearest to the group's mean routes it
            mean = self.points[g].mean(axis=0)
            centres.append(self.points[g[int(self._distance(g, mean).argmin())]])
        made = np.array(centres)
        children = [self._build(g, c) for g, c in zip(groups, made, strict=True)]
        radii = np.array([self._distance(g, c).max() for g, c in zip(groups, made, strict=True)])
        return Node(children, None, made, radii, np.sqrt(((made - centre) ** 2).sum(axis=1)))

    def _split(self, rows: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        fan = min(PAGE, -(-len(rows) // PAGE), max(2, int(round(len(rows) ** 0.5 / 8)) * 2))
        picks = rows[np.argsort(far, kind="stable")[np.linspace(0, len(rows) - 1, fan).astype(int)]]
        pivots = self.points[picks]
        for _ in range(2):
            cross = self.points[rows] @ pivots.T
            owner = ((pivots**2).sum(axis=1)[None, :] - 2 * cross).argmin(axis=1)
            pivots = np.array([self.points[rows[owner == k]].mean(axis=0) if (owner == k).any() else pivots[k] for k in range(fan)])
        groups = [rows[owner == k] for k in range(fan)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1 or max(map(len, groups)) > 0.9 * len(rows):  # alike vectors: cut by distance
            return np.array_split(rows[np.argsort(far, kind="stable")], max(2, fan))
        return groups

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, tally: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of the k largest products of each query, without vectors of the query's own id.

        Best-first for all queries in step: in each round every query takes the nodes of least possible distance from
        its own frontier, queries that take the same node are handled together, and a query is done once its frontier
        has no node within the distance of its k-th result. ``tally`` counts the vectors scored, over all queries.
        """
        n = len(queries)
        exact = queries.astype(np.float64)
        square = (exact**2).sum(axis=1)
        points = np.column_stack((exact, np.zeros(n)))
        whole = square + self.bound
        slack = SLACK * (whole + 1.0)
        small = self.small and float(square.max(initial=0.0)) < 2.0**52
        integers = None if small else queries.astype(np.int64)
        none = np.zeros(0, np.int64)
        best = (none, none, none)  # query, id, score in final order
        if self.root is None or k < 1 or not n:
            return best
        last = np.full(n, -(2**62), np.int64)  # score of the k-th so far
        reach = np.full(n, np.inf)
        nodes = [self.root]
        front_q, front_node = np.arange(n), np.zeros(n, np.int64)
        front_low = np.zeros(n)
        front_far = np.sqrt(((points - self.centre) ** 2).sum(axis=1))
        take = 1
        while len(front_q):
            order = np.lexsort((front_low, front_q))
            front_q, front_node, front_low, front_far = front_q[order], front_node[order], front_low[order], front_far[order]
            place = np.arange(len(front_q)) - np.searchsorted(front_q, front_q)
            now = place < take
            q, node, far = front_q[now], front_node[now], front_far[now]
            kept = [[front_q[~now]], [front_node[~now]], [front_low[~now]], [front_far[~now]]]
            order = np.argsort(node, kind="stable")
            q, node, far = q[order], node[order], far[order]
            cuts = np.flatnonzero(np.diff(node)) + 1
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for mine, at, away in zip(np.split(q, cuts), node[np.concatenate(([0], cuts))].tolist(), np.split(far, cuts), strict=True):
                page = nodes[at]
                gap = np.abs(away[:, None] - page.parent[None, :])
                if page.children is None:
                    # what the stored parent distance rules out for a query is not scored for it
                    i, j = np.nonzero(gap <= reach[mine][:, None])
                    if tally is not None:
                        tally["scored"] = tally.get("scored", 0) + len(i)
                    a, b = mine[i], page.rows[j]
                    if 8 * len(i) < gap.size:
                        score = np.einsum("ij,ij->i", exact[a], self.exact[b]).astype(np.int64) if small else (integers[a] * self.vectors[b]).sum(axis=1)
                    else:  # most pairs are open: one product for all
                        grid = (exact[mine] @ self.exact[page.rows].T).astype(np.int64) if small else integers[mine] @ self.vectors[page.rows].T
                        score = grid[i, j]
                    good = (score >= last[a]) & (self.ids[b] != own[a])
                    if good.any():
                        found.append((a[good], self.ids[b[good]], score[good]))
                else:
                    i, j = np.nonzero(gap - page.radii[None, :] <= reach[mine][:, None])
                    if not len(i):
                        continue
                    distance = np.sqrt(np.maximum(((points[mine[i]] - page.centres[j]) ** 2).sum(axis=1), 0.0))
                    low = np.maximum(distance - page.radii[j], 0.0) * (1 - SLACK) - SLACK
                    if page.numbers is None:
                        page.numbers = np.arange(len(nodes), len(nodes) + len(page.children))
                        nodes += page.children
                    for into, part in zip(kept, (mine[i], page.numbers[j], low, distance), strict=True):
                        into.append(part)
            if found:
                all_q, all_id, all_score = (np.concatenate(x) for x in zip(best, *found, strict=True))
                order = np.lexsort((all_id, -all_score, all_q))
                all_q, all_id, all_score = all_q[order], all_id[order], all_score[order]
                place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
                first = place < k
                best = (all_q[first], all_id[first], all_score[first])
                full = place == k - 1
                last[all_q[full]] = all_score[full]
                reach[all_q[full]] = np.sqrt(np.maximum(whole[all_q[full]] - 2.0 * all_score[full], 0.0) + slack[all_q[full]]) * (1 + SLACK) + SLACK
                take = min(8, take * 2)
            front_q, front_node, front_low, front_far = (np.concatenate(x) for x in kept)
            near = front_low <= reach[front_q]
            front_q, front_node, front_low, front_far = front_q[near], front_node[near], front_low[near], front_far[near]
        for node in nodes:
            node.numbers = None
        return best


def quantised(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, vector (int32 little-endian): floor(scale * component) of the vectors that take part."""
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.floor(scale * np.asarray(lists.flatten()).astype(np.float64))
            if len(flat) and np.abs(flat).max() > 2**26:
                raise ValueError("a component is too large for exact products")
            ends = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))))
            data = flat.astype("<i4").tobytes()
            yield pa.record_batch([batch.column(0), pa.array([data[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["vec_id", "vector"])

    return rows.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, vector binary")


def _matrix(data: list[bytes]) -> np.ndarray:
    wide = max(map(len, data), default=0)
    return np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in data), "<i4").reshape(len(data), wide // 4)


def _aligned(query: np.ndarray, wide: int) -> np.ndarray:
    """A query for vectors of ``wide`` components: what either lacks is zero."""
    return np.pad(query[:wide], (0, max(0, wide - len(query))))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row, the k largest integer inner products with all other rows."""
    vectors = quantised(rows, scale)
    n = rows.count()
    shards = max(-(-n // shard), min(8, -(-n // LEAST)), 1)
    mine = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    candidates = vectors.select(mine.alias("shard"), F.lit(0).alias("kind"), "vec_id", "vector")
    queries = quantised(rows.filter(is_query), scale).dropDuplicates(["vec_id"])
    copies = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "vector")
    parts = max(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = candidates.unionByName(copies).repartition(parts, "shard").sortWithinPartitions("shard", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[np.ndarray] = []
        held: list[bytes] = []
        tree, wide, current = None, 0, None
        for batch in batches:
            shard_of, kind, ids = (np.asarray(batch.column(c)) for c in range(3))
            data = batch.column(3).to_pylist()
            cuts = np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if shard_of[a] != current:
                    held_ids, held, tree, current = [], [], None, shard_of[a]
                if kind[a] == 0:
                    held_ids.append(ids[a:b])
                    held += data[a:b]
                    continue
                if tree is None:
                    matrix = _matrix(held)
                    tree, wide = MTree(np.concatenate([np.zeros(0, np.int64), *held_ids]), matrix), matrix.shape[1]
                    held = []
                for c in range(a, b, QUERIES):
                    own = ids[c : min(b, c + QUERIES)]
                    queries = np.stack([_aligned(np.frombuffer(v, "<i4"), wide) for v in data[c : min(b, c + QUERIES)]])
                    q, found, score = tree.search(queries, own, k)
                    yield pa.record_batch([pa.array(own[q]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    found = dealt.select("shard", "kind", "vec_id", "vector").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
