"""Approximate nearest neighbours: a navigable small-world graph for each shard, results merged.

Vectors are dealt by a hash of their id into shards: as many as there are tasks to build them, but none under MIN_ROWS
and none over SHARD_ROWS vectors, so the work of a search grows with rows / SHARD_ROWS.  Each shard builds one
hierarchical graph and stores it as flat neighbour arrays: for level l an (n_l, m) block of positions, -1 where a place
is free.  Equal vectors of a shard are one node that carries its smallest ids, since a clump of copies would only link to
itself.  A shard's graph travels once, in blocks of rows, and the queries stream past it; the shards' nearest are merged
by (distance, id).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id,
take no part, either as query or as candidate; vectors of another length than the query's are no candidates; ties go to
the smaller id.  Every row is a query and a candidate of its own: rows that repeat a vec_id with another vector get lists
of their own (query_no tells them apart), each row leaves out itself alone, and a list may name a
vec_id twice.  Columns besides id and vector don't matter.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

M, EF_BUILD, EF_SEARCH = 16, 64, 112
EF_ROWS = 4096  # a search keeps EF_SEARCH candidates in a graph of so many nodes, more by the square root in larger ones
MIN_ROWS, SHARD_ROWS = 2048, 1 << 15
BLOCK_BYTES = 4 << 20  # of one row of a stored graph, about


class Graph:
    """Hierarchical navigable small-world graph over distinct vectors."""

    def __init__(self, x: np.ndarray, m: int = M, ef: int = EF_BUILD, levels: list[np.ndarray] | None = None, start: int = 0):
        self.x, self.m, self.ef, self.start = x, m, ef, start
        if levels is not None:
            self.levels = levels
            return
        n = len(x)
        rng = np.random.default_rng(n)
        height = np.floor(-np.log(1 - rng.random(n)) / math.log(m)).astype(int) if n else np.zeros(0, int)
        self.levels = [np.full((n, 2 * m), -1, np.int32)]  # a row for each node at level 0
        self.levels += [np.full((n, m), -1, np.int32) for _ in range(int(height.max(initial=0)))]
        self.top = -1
        for k in range(n):
            self._insert(k, int(height[k]))

    def _near(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = self.x[at] - q
        return np.einsum("ij,ij->i", d, d)

    def search_level(self, q: np.ndarray, starts: list[tuple[float, int]], level: int, ef: int) -> list[tuple[float, int]]:
        """The ef nearest that are found, nearest first."""
        links, seen = self.levels[level], np.zeros(len(self.x), bool)
        todo = list(starts)
        heapq.heapify(todo)
        best = [(-d, p) for d, p in starts]
        heapq.heapify(best)
        for _, p in starts:
            seen[p] = True
        while todo:
            d, p = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = links[p]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            dist = self._near(q, near)
            if len(best) >= ef:
                ok = dist < -best[0][0]
                near, dist = near[ok], dist[ok]
            for e, j in zip(dist.tolist(), near.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (-e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                else:
                    continue
                heapq.heappush(todo, (e, j))
        return sorted((-d, p) for d, p in best)

    def _select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions first: one is passed over if a chosen one is nearer to it than the node."""
        if len(found) <= most:
            return [p for _, p in found]
        at = np.array([p for _, p in found])
        x = self.x[at]
        square = np.einsum("ij,ij->i", x, x)
        between = square[:, None] + square[None, :] - 2 * (x @ x.T)
        own = np.array([d for d, _ in found])
        least = np.full(len(at), np.inf)
        chosen, passed = [], []
        for k in range(len(at)):
            if least[k] > own[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.minimum(least, between[k], out=least)
            else:
                passed.append(k)
        return at[(chosen + passed)[:most]].tolist()

    def _insert(self, k: int, height: int) -> None:
        if self.top < 0:
            self.start, self.top = k, height
            return
        q = self.x[k]
        at = [(float(self._near(q, np.array([self.start]))[0]), self.start)]
        for level in range(self.top, height, -1):
            at = self.search_level(q, at, level, 1)
        for level in range(min(self.top, height), -1, -1):
            at = self.search_level(q, at, level, self.ef)
            links = self.levels[level]
            chosen = self._select(at, self.m)
            links[k, : len(chosen)] = chosen
            for j in chosen:
                row = links[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = k
                else:
                    both = np.append(row, k)
                    dist = self._near(self.x[j], both)
                    order = np.argsort(dist, kind="stable")
                    row[:] = self._select(list(zip(dist[order].tolist(), both[order].tolist())), len(row))
        if height > self.top:
            self.start, self.top = k, height

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[int]:
        if not len(self.x):
            return []
        at = [(float(self._near(q, np.array([self.start]))[0]), self.start)]
        for level in range(len(self.levels) - 1, 0, -1):
            at = self.search_level(q, at, level, 1)
        return [p for _, p in self.search_level(q, at, 0, max(ef, k))[:k]]


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dims) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.where(F.col(key).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dims"))


def dealt(points: DataFrame, shards: int, *columns) -> DataFrame:
    """Points in partitions by shard; each shard's rows lie together, in the order of the columns."""
    keyed = points.repartitionByRange(shards, "shard") if shards > 1 else points.coalesce(1)
    return keyed.sortWithinPartitions("shard", "dims", *columns)


def groups(batches, keys: int):
    """(key, rows) of runs with equal first columns; the rows of a run come as slices, as they arrive."""
    for b in batches:
        columns = [b.column(k).to_numpy() for k in range(keys)]
        turn = np.zeros(max(0, b.num_rows - 1), bool)
        for c in columns:
            turn |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), b.num_rows] if b.num_rows else [0]
        for a, z in zip(cuts, cuts[1:]):
            yield tuple(int(c[a]) for c in columns), b.slice(a, z - a)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


INDEX = "dims int, shard int, part string, no int, start int, width int, payload binary"


def build(points: DataFrame, shards: int, k: int = 10) -> DataFrame:
    """The shards' graphs, one for each vector length, in rows of about BLOCK_BYTES: the vectors (part x), the neighbour
    array of level l (part l), and the nodes' ids with the number of each one's ids before them (parts ids and first).

    A node keeps its k + 1 smallest ids: no more can be among a query's k nearest with ties to smaller ids."""

    def run(batches, schema):
        C.release()
        now, xs, ids = None, [], []

        def made():
            dims, shard = now[1], now[0]
            x, inverse = np.unique(np.concatenate(xs), axis=0, return_inverse=True)
            own = np.concatenate(ids)
            order = np.lexsort((own, inverse.ravel()))
            cuts = np.searchsorted(inverse.ravel()[order], np.arange(len(x) + 1))
            mix = np.random.default_rng(len(x)).permutation(len(x))  # sorted vectors would enter in a bad order
            graph = Graph(np.ascontiguousarray(x[mix]))
            held = [own[order[cuts[j] : cuts[j + 1]]][: k + 1] for j in mix]
            first = np.cumsum([0, *map(len, held)])
            parts = [("x", graph.x), *((f"{level:03d}", a) for level, a in enumerate(graph.levels)), ("ids", np.concatenate(held)[:, None]), ("first", first[:, None])]
            for name, a in parts:
                step = max(1, BLOCK_BYTES // (a.shape[1] * a.itemsize))
                for no, at in enumerate(range(0, len(a), step)):
                    yield C.record_batch([[dims], [shard], [name], [no], [graph.start], [a.shape[1]], [np.ascontiguousarray(a[at : at + step]).tobytes()]], schema)

        for key, b in groups(batches, 2):
            if now is not None and key != now:
                yield from made()
                xs, ids = [], []
            now = key
            xs.append(matrix(b.column(3), key[1]))
            ids.append(b.column(2).to_numpy())
        if now is not None:
            yield from made()

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    return C.map_arrow(dealt(points.select(shard.alias("shard"), "dims", "vec_id", "v"), shards, "vec_id"), run, INDEX)


def width_for(rows: int, ef: int) -> int:
    """Candidates that a search keeps: a wider search in a larger graph keeps recall level."""
    return max(ef, math.ceil(ef * math.sqrt(rows / EF_ROWS)))


class Stored:
    """A shard's graph, put together again from its rows."""

    def __init__(self, parts: dict[str, list[bytes]], dims: int, start: int, widths: dict[str, int]):
        whole = {k: b"".join(v) for k, v in parts.items()}
        self.x = np.frombuffer(whole["x"]).reshape(-1, dims)
        levels = [np.frombuffer(whole[k], np.int32).reshape(-1, widths[k]) for k in sorted(k for k in whole if k.isdigit())]
        self.graph = Graph(self.x, levels=levels, start=start)
        self.rows = len(self.x)
        self.ids, self.first = np.frombuffer(whole["ids"], np.int64), np.frombuffer(whole["first"], np.int64)

    def near(self, own: int, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        """The k nearest (distance, id) that are found; one row that is the query itself is left out."""
        out, left_out = [], False
        for p in self.graph.search(q, k + 1, width_for(self.rows, ef)):
            d = float(np.sqrt(((self.x[p] - q) ** 2).sum()))
            for i in self.ids[self.first[p] : self.first[p + 1]].tolist():
                if d == 0 and i == own and not left_out:
                    left_out = True
                else:
                    out.append((d, i))
        return sorted(out)[:k]


def search(index: DataFrame, queries: DataFrame, shards: int, k: int = 10, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score, query_no: the merged k nearest of every query, its own row left out.

    Each shard's graph comes first in its partition, and all queries stream past it."""
    none = lambda kind: F.lit(None).cast(kind)
    stored = index.select("shard", "dims", F.lit(0).alias("turn"), "part", "no", "start", "width", "payload", none("long").alias("q_id"), none("long").alias("q_no"), none("array<double>").alias("v"))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asked = asked.select("shard", "dims", F.lit(1).alias("turn"), none("string").alias("part"), none("int").alias("no"), none("int").alias("start"), none("int").alias("width"), none("binary").alias("payload"), F.col("vec_id").alias("q_id"), "q_no", "v")

    def look(batches, schema):
        C.release()
        at, parts, widths, start, one = None, {}, {}, 0, None
        for (shard, dims, turn), b in groups(batches, 3):
            if (shard, dims) != at:
                at, parts, widths, one = (shard, dims), {}, {}, None
            if turn == 0:
                for name, begin, width, payload in zip(*(b.column(c).to_pylist() for c in (3, 5, 6, 7))):
                    parts.setdefault(name, []).append(payload)
                    widths[name], start = width, begin
            elif parts:
                one = one or Stored(parts, dims, start, widths)
                out = [(q, no, i, d) for q, no, v in zip(b.column(8).to_pylist(), b.column(9).to_pylist(), matrix(b.column(10), dims)) for d, i in one.near(q, v, k, ef)]
                if out:
                    yield C.record_batch(list(zip(*out)), schema)

    found = C.map_arrow(dealt(stored.unionByName(asked), shards, "turn", "part", "no", "q_id"), look, "query_id long, query_no long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_no")


def shards_for(rows: int, tasks: int, shard_rows: int = SHARD_ROWS, min_rows: int = MIN_ROWS) -> int:
    """As many shards as tasks, in bounds of their size."""
    return max(1, math.ceil(rows / shard_rows), min(tasks, rows // min_rows))


def nearest(table: DataFrame, is_query, k: int = 10, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS, min_rows: int = MIN_ROWS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Index every usable row and search it for the rows that is_query picks."""
    points = vectors(table, key, column)
    rows = points.where(is_query)
    queries = C.stash(rows.select("vec_id", "v", "dims", F.monotonically_increasing_id().alias("q_no")))
    shards = shards_for(points.count(), C.partitions(table.sparkSession), shard_rows, min_rows)
    index = C.stash(build(points, shards, k))
    out = C.stash(search(index, queries, shards, k, ef))
    C.forget(index, queries)
    return out
