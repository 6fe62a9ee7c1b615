"""Line dedup over cuckoo filters in shards, backed by exact reference-count tables.

A line's key is the line without white space at its ends and with A-Z lower-cased.  The reference-count table
holds, for each key's 128-bit hash, the number of documents that have it and the smallest of their ids.  The keys that
reach the threshold go into cuckoo filters, one a shard, with the exact keys beside them.  LineIndex keeps both:
inserting or deleting documents adds or subtracts counts, and only the keys that crossed the threshold are inserted into
or deleted from their shard's filter, so a change can be taken back exactly.  A line is looked up in its shard's filter
first, and what passes is confirmed by the shard's exact keys, so false positives drop nothing.

Filters and exact keys travel to the documents as one broadcast while their checked size is at most BROADCAST_BYTES;
beyond it the lines' hashes travel to their shard's filter, a shard with many lines being dealt to several tasks.

Defined results: a null or empty text is one empty line; empty keys are never dropped; every row counts as a document of
its own, also where rows share a doc_id; a null doc_id counts, but is never the first document; with keep_first a line
whose documents all have a null doc_id stays in all of them, and where rows share the first doc_id each of them keeps it.
A text of any length is handled as one value; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS = 10
SHARDS, SHARD_KEYS = 64, 1 << 20  # shards at least, and dropped keys in one of them, about
BROADCAST_BYTES = 64 << 20
ROUTE_ROWS = 1 << 22  # lines that meet one copy of a shard's filter, about
FLUSH_KEYS = 50_000
SLOTS = 4
UNKNOWN = -(1 << 63)  # stands for a first document without an id


def keys_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """A text's lines and their keys, as UTF-8."""
    raw = (text or "").encode()
    return raw.split(b"\n"), [x.strip() for x in raw.lower().split(b"\n")]  # bytes: ASCII only, as the key wants


def hash_key(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; insert, delete and look up by (h1, h2)."""

    def __init__(self, room: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, math.ceil(math.log2(max(1, room) / SLOTS / 0.85 + 1)))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table, self.mask = table, len(table) - 1

    @staticmethod
    def _prints(h2: np.ndarray) -> np.ndarray:
        fp = (h2 & np.uint64(0xFFFF)).astype(np.uint64)
        return np.where(fp == 0, np.uint64(1), fp)

    def _places(self, h1: np.ndarray, fp: np.ndarray):
        a = (h1 >> np.uint64(16)) & np.uint64(self.mask)
        return a, self._other(a, fp)

    def _other(self, at, fp):
        with np.errstate(over="ignore"):  # a wrapping product spreads the fingerprint
            return at ^ ((fp * np.uint64(0x5BD1E995)) & np.uint64(self.mask))

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fp = self._prints(h2)
        a, b = self._places(h1, fp)
        short = fp.astype(np.uint16)[:, None]
        return (self.table[a] == short).any(1) | (self.table[b] == short).any(1)

    def insert(self, h1: int, h2: int) -> bool:
        """False where the table is too full; it is then as it was before, and the caller builds a larger one."""
        fp = self._prints(np.array([h2], np.uint64))
        (a,), (b,) = (x for x in self._places(np.array([h1], np.uint64), fp))
        fp, at = fp[0], a
        for place in (a, b):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = fp
                return True
        undo = []
        for kick in range(500):
            slot = kick % SLOTS
            undo.append((at, slot, self.table[at, slot]))
            self.table[at, slot], fp = fp, np.uint64(self.table[at, slot])
            at = self._other(at, fp)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return True
        for place, slot, old in reversed(undo):
            self.table[place, slot] = old
        return False

    def insert_all(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Insert many keys: those that find a free slot together, the others one by one; False as in insert, but with
        some of the keys already in the table."""
        fp = self._prints(h2)
        left = np.arange(len(h1))
        for side in (0, 1):
            at = self._places(h1[left], fp[left])[side].astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, who = at[order], left[order]
            turn = np.arange(len(at)) - np.searchsorted(at, at, "left")  # the n-th that asks for this bucket
            free = np.argsort(self.table[at] != 0, axis=1, kind="stable")  # free slots first
            room = (self.table[at] == 0).sum(1)
            ok = turn < room
            self.table[at[ok], free[ok, turn[ok]]] = fp[who[ok]].astype(np.uint16)
            left = who[~ok]
        return all(self.insert(a, b) for a, b in zip(h1[left].tolist(), h2[left].tolist()))

    def delete(self, h1: int, h2: int) -> bool:
        fp = self._prints(np.array([h2], np.uint64))
        (a,), (b,) = (x for x in self._places(np.array([h1], np.uint64), fp))
        for place in (a, b):
            slot = np.flatnonzero(self.table[place] == fp[0])
            if len(slot):
                self.table[place, slot[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> Cuckoo:
        room = len(h1)
        while True:
            out = cls(room)
            if out.insert_all(h1, h2):
                return out
            room = 2 * room + SLOTS


def refcounts(docs: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, first_doc): the exact reference-count table of a set of documents."""

    def packed(seen: dict):
        h = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
        return h[:, 0], h[:, 1], [x[0] for x in seen.values()], [x[1] for x in seen.values()]

    def count(parts):
        C.release()
        seen: dict[bytes, list] = {}
        for ids, texts in parts:
            for i, t in zip(ids, texts):
                for k in set(keys_of(t)[1]):
                    if k:
                        if (got := seen.get(h := hash_key(k))) is None:
                            seen[h] = [1, i]
                        else:
                            got[0] += 1
                            if i is not None and (got[1] is None or i < got[1]):
                                got[1] = i
            if len(seen) >= FLUSH_KEYS:
                yield packed(seen)
                seen = {}
        yield packed(seen)

    return _summed(C.map_texts(docs, count, "h1 long, h2 long, n_docs long, first_doc long"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))


def insert(table: DataFrame, added: DataFrame) -> DataFrame:
    """The table after inserting documents whose own table is added."""
    return _summed(table.unionByName(added))


def delete(table: DataFrame, removed: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """The table after deleting documents whose own table is removed; keys of no document go.

    A first document that may have gone is looked up in left, the table of the documents that stay, where given;
    else it is unknown (null)."""
    less = removed.select("h1", "h2", F.col("n_docs").alias("gone"), F.col("first_doc").alias("gone_first"))
    out = table.join(less, ["h1", "h2"], "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("gone", F.lit(0))).where("n_docs > 0")
    lost = F.col("gone_first").isNotNull() & (F.col("gone_first") == F.col("first_doc"))
    if left is None:
        return out.select("h1", "h2", "n_docs", F.when(~F.coalesce(lost, F.lit(False)), F.col("first_doc")).alias("first_doc"))
    kept = left.select("h1", "h2", F.col("first_doc").alias("kept_first"))
    return out.join(kept, ["h1", "h2"], "left").select("h1", "h2", "n_docs", F.when(F.coalesce(lost, F.lit(False)), F.col("kept_first")).otherwise(F.col("first_doc")).alias("first_doc"))


SHARD = "shard int, cuckoo binary, h1s binary, h2s binary, firsts binary"


def _shard_of(shards: int):
    return F.pmod("h1", F.lit(shards)).cast("int").alias("shard")


def _first():
    return F.coalesce("first_doc", F.lit(UNKNOWN).cast("long")).alias("first_doc")


def _long(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False)


def _packed_shard(shard: int, cuckoo: Cuckoo, h1: np.ndarray, h2: np.ndarray, firsts: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "cuckoo": [cuckoo.table.tobytes()], "h1s": [h1.tobytes()], "h2s": [h2.tobytes()], "firsts": [firsts.tobytes()]})


def filters(hot: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, cuckoo, h1s, h2s, firsts): each shard's filter and the exact keys behind it, sorted, for the keys to drop."""

    def build(rows: pa.Table) -> pa.Table:
        h1, h2, firsts = (_long(rows[c]) for c in ("h1", "h2", "first_doc"))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        return _packed_shard(rows["shard"][0].as_py(), Cuckoo.of(h1.view(np.uint64), h2.view(np.uint64)), h1, h2, firsts[order])

    return hot.select(_shard_of(shards), "h1", "h2", _first()).groupBy("shard").applyInArrow(build, SHARD)


def update_filter(cuckoo: Cuckoo, up: list[tuple[int, int]], down: list[tuple[int, int]]) -> bool:
    """Keys that crossed the threshold upwards are inserted, those that crossed it downwards deleted; False: rebuild."""
    for h1, h2 in down:
        cuckoo.delete(h1, h2)
    return all(cuckoo.insert(h1, h2) for h1, h2 in up)


def update_filters(found: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """The shards' rows after changes (h1, h2, first_doc, step): step 1 for keys that come, -1 for keys that go, 0 for
    keys whose first document is another one now.  A filter that gets too full is built anew from its exact keys."""

    def one(rows: pa.Table, steps: pa.Table) -> pa.Table:
        shard = (rows if rows.num_rows else steps)["shard"][0].as_py()
        if rows.num_rows:
            h1, h2, firsts = (np.frombuffer(rows[c][0].as_py(), "<i8") for c in ("h1s", "h2s", "firsts"))
            cuckoo = Cuckoo(table=np.frombuffer(rows["cuckoo"][0].as_py(), np.uint16).reshape(-1, SLOTS).copy())
        else:
            h1 = h2 = firsts = np.empty(0, np.int64)
            cuckoo = Cuckoo()
        if steps.num_rows:
            a, b, f, step = (_long(steps[c]) for c in ("h1", "h2", "first_doc", "step"))
            h1, h2, firsts = np.r_[h1, a], np.r_[h2, b], np.r_[firsts, f]
            stays = np.r_[np.ones(len(h1) - len(a), bool), step >= 0]
            order = np.lexsort((np.arange(len(h1)), h2, h1))  # of equal keys the change comes last
            h1, h2, firsts, stays = h1[order], h2[order], firsts[order], stays[order]
            last = np.r_[(h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]), True] & stays
            h1, h2, firsts = h1[last], h2[last], firsts[last]
            pairs = lambda at: list(zip(a[at].view(np.uint64).tolist(), b[at].view(np.uint64).tolist()))
            if not update_filter(cuckoo, pairs(step > 0), pairs(step < 0)):
                cuckoo = Cuckoo.of(h1.view(np.uint64), h2.view(np.uint64))
        return _packed_shard(shard, cuckoo, h1, h2, firsts)

    dealt = changes.select(_shard_of(shards), "h1", "h2", _first(), F.col("step").cast("long").alias("step"))
    return found.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(one, SHARD)


@dataclass
class LineIndex:
    """The exact counts of a set of documents and the filters over the keys that at least min_docs of them have."""

    table: DataFrame
    found: DataFrame
    shards: int
    min_docs: int

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
        return cls._build(C.stash(refcounts(docs)), min_docs)

    @classmethod
    def _build(cls, table: DataFrame, min_docs: int) -> LineIndex:
        hot = table.where(F.col("n_docs") >= min_docs)
        shards = max(SHARDS, math.ceil(hot.count() / SHARD_KEYS))
        return cls(table, C.stash(filters(hot, shards)), shards, min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._moved(C.stash(insert(self.table, refcounts(docs))))

    def delete(self, docs: DataFrame, left: DataFrame | None = None) -> LineIndex:
        """Without docs, which must have been inserted before; left, the documents that stay, names first documents anew."""
        return self._moved(C.stash(delete(self.table, refcounts(docs), None if left is None else refcounts(left))))

    def _moved(self, table: DataFrame) -> LineIndex:
        """The index with another table; the one before is still whole, and its stashes are the caller's to forget."""
        was = self.table.where(F.col("n_docs") >= self.min_docs).select("h1", "h2", F.col("first_doc").alias("was"), F.lit(True).alias("old"))
        now = table.where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "first_doc", F.lit(True).alias("new"))
        both = was.join(now, ["h1", "h2"], "full")
        step = F.when(F.col("old").isNull(), 1).when(F.col("new").isNull(), -1).otherwise(0)
        changes = both.select("h1", "h2", "first_doc", step.alias("step"), F.col("was").eqNullSafe(F.col("first_doc")).alias("same")).where("step <> 0 or not same")
        out = LineIndex(table, C.stash(update_filters(self.found, changes, self.shards)), self.shards, self.min_docs)
        keys = out.found.agg(F.sum(F.length("h1s") / 8).alias("n")).first()["n"] or 0
        if keys <= 2 * self.shards * SHARD_KEYS:
            return out
        C.forget(out.found)
        return self._build(table, self.min_docs)

    def nbytes(self) -> int:
        return self.found.agg(F.sum(F.length("cuckoo") + F.length("h1s") + F.length("h2s") + F.length("firsts")).alias("n")).first()["n"] or 0


class Shard:
    """One shard's filter and its exact keys, as sorted arrays."""

    def __init__(self, cuckoo: bytes, h1: bytes, h2: bytes, firsts: bytes):
        self.cuckoo = Cuckoo(table=np.frombuffer(cuckoo, np.uint16).reshape(-1, SLOTS))
        self.h1, self.h2, self.firsts = (np.frombuffer(x, "<i8") for x in (h1, h2, firsts))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the (n, 2) hashes that are dropped keys, and those keys' first documents."""
        unsigned = np.ascontiguousarray(hashes).view(np.uint64)
        at = np.flatnonzero(self.cuckoo.contains(unsigned[:, 0], unsigned[:, 1]))
        place = np.searchsorted(self.h1, hashes[at, 0])
        hit = np.full(len(at), -1)
        while True:  # keys with equal first halves lie side by side
            open_ = np.flatnonzero((hit < 0) & (place < len(self.h1)))
            open_ = open_[self.h1[place[open_]] == hashes[at[open_], 0]]
            if not len(open_):
                break
            same = self.h2[place[open_]] == hashes[at[open_], 1]
            hit[open_[same]] = place[open_[same]]
            place[open_[~same]] += 1
        ok = hit >= 0
        return at[ok], self.firsts[hit[ok]]


def find(by: dict[int, Shard], shards: int, hashes: np.ndarray) -> dict[int, int]:
    """Positions of the hashes that are dropped keys of any shard, with each key's first document."""
    out: dict[int, int] = {}
    shard = np.mod(hashes[:, 0], shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if len(order) else np.zeros(1, int)
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if (one := by.get(int(shard[order[a]]))) is not None:
            at, firsts = one.find(hashes[order[a:z]])
            out.update(zip(order[a:z][at].tolist(), firsts.tolist()))
    return out


def drop_lines(text: str | None, gone, doc_id: int | None, keep_first: bool) -> tuple[int, int, str]:
    """n_lines, n_dropped and the text left; gone maps a key's hash to its first document."""
    lines, keys = keys_of(text)
    kept, mine = [], set()
    for line, key in zip(lines, keys):
        first = gone.get(hash_key(key)) if key else None
        if first == UNKNOWN and keep_first:  # no document can be named that keeps it
            first = None
        if first is not None and keep_first and first == doc_id and key not in mine:
            mine.add(key)
            first = None
        if first is None:
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode()


KEPT = "struct<n_lines: long, n_dropped: long, text: string>"


def _kept_column(b: pa.RecordBatch, id_at: int, text_at: int, gone, keep_first: bool, kind: pa.DataType) -> pa.Array:
    ids, texts = b.column(id_at).to_pylist(), b.column(text_at).to_pylist()
    rows = [drop_lines(t, g, None if i is None else int(i), keep_first) for i, t, g in zip(ids, texts, gone)]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], fields=list(kind))


def _apply_broadcast(docs: DataFrame, index: LineIndex, keep_first: bool, name: str) -> DataFrame:
    rows = [(r["shard"], bytes(r["cuckoo"]), bytes(r["h1s"]), bytes(r["h2s"]), bytes(r["firsts"])) for r in index.found.collect()]
    shared, shards = docs.sparkSession.sparkContext.broadcast(rows), index.shards
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches, schema):
        C.release()
        by = {r[0]: Shard(*r[1:]) for r in shared.value}
        for b in C.slices(batches, text_at):
            distinct = list({hash_key(k) for t in b.column(text_at).to_pylist() for k in keys_of(t)[1] if k})
            hit = find(by, shards, np.frombuffer(b"".join(distinct), "<i8").reshape(-1, 2))
            gone = {distinct[k]: first for k, first in hit.items()}
            column = _kept_column(b, id_at, text_at, [gone] * b.num_rows, keep_first, schema.field(len(schema) - 1).type)
            yield C.record_batch([*b.columns, column], schema)

    return C.map_arrow(docs, run, C.with_field(docs.schema, name, KEPT))


def routed(lines: DataFrame, index: LineIndex) -> DataFrame:
    """(t1, t2, h1, h2, first_doc) of the lines (t1, t2, h1, h2) that are dropped keys.

    A line's hash travels to its shard's filter; a shard is dealt to as many tasks as its lines ask for, as the exact
    counts tell, each with a copy of the filter.  In a task the filter comes first and the lines stream past it."""
    shards, table = index.shards, index.table
    load = table.groupBy(_shard_of(shards)).agg(F.sum("n_docs").alias("n"))
    deals = np.ones(shards, np.int64)
    for r in load.collect():
        deals[r["shard"]] = max(1, math.ceil(r["n"] / ROUTE_ROWS))
    deal = F.element_at(F.array(*map(F.lit, deals.tolist())), F.col("shard") + 1)
    none = lambda kind: F.lit(None).cast(kind)
    asked = lines.withColumn("shard", _shard_of(shards)).select("shard", F.pmod("t1", deal).cast("int").alias("deal"), F.lit(1).alias("turn"), "t1", "t2", "h1", "h2", *(none("binary").alias(c) for c in ("cuckoo", "h1s", "h2s", "firsts")))
    each = index.found.withColumn("deal", F.explode(F.sequence(F.lit(0), (deal - 1).cast("int")))).select("shard", "deal", F.lit(0).alias("turn"), *(none("long").alias(c) for c in ("t1", "t2", "h1", "h2")), "cuckoo", "h1s", "h2s", "firsts")

    def run(batches, schema):
        C.release()
        now, one = None, None
        for b in batches:
            turn, shard, dealt = (b.column(k).to_numpy() for k in (2, 0, 1))
            cuts = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | (np.diff(dealt) != 0) | (np.diff(turn) != 0), True])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if turn[a] == 0:
                    now, one = (shard[a], dealt[a]), Shard(*(b.column(k)[a].as_py() for k in (7, 8, 9, 10)))
                elif now == (shard[a], dealt[a]):
                    t1, t2, h1, h2 = (b.column(k).slice(a, z - a).to_numpy() for k in (3, 4, 5, 6))
                    at, firsts = one.find(np.column_stack([h1, h2]))
                    if len(at):
                        yield C.record_batch([t1[at], t2[at], h1[at], h2[at], firsts], schema)

    parts = max(C.partitions(lines.sparkSession), int(deals.sum()))
    dealt = each.unionByName(asked).repartition(parts, "shard", "deal").sortWithinPartitions("shard", "deal", "turn")
    return C.map_arrow(dealt, run, "t1 long, t2 long, h1 long, h2 long, first_doc long")


def _apply_routed(docs: DataFrame, index: LineIndex, keep_first: bool, name: str) -> DataFrame:
    """The same beyond the bound.  A text's dropped keys are no more than its own lines; equal texts ask once."""
    t1, t2, gone = (C.fresh(docs, x) for x in ("t1", "t2", "gone"))
    named = docs.withColumns({t1: F.coalesce(F.xxhash64("text"), F.lit(0)), t2: F.xxhash64(F.lit(1), "text")})

    def lines(batches, schema):
        for b in C.slices(batches, 2):
            out = [(a, z, *np.frombuffer(h, "<i8").tolist()) for a, z, t in zip(*(b.column(k).to_pylist() for k in range(3))) for h in {hash_key(k) for k in keys_of(t)[1] if k}]
            if out:
                yield C.record_batch(list(zip(*out)), schema)

    asked = named.select(F.col(t1).alias("t1"), F.col(t2).alias("t2"), "text").dropDuplicates(["t1", "t2"])
    hits = routed(C.map_arrow(asked, lines, "t1 long, t2 long, h1 long, h2 long"), index)
    listed = hits.groupBy(F.col("t1").alias(t1), F.col("t2").alias(t2)).agg(F.collect_list(F.struct("h1", "h2", "first_doc")).alias(gone))
    joined = named.join(listed, [t1, t2], "left").select(*docs.columns, gone)
    id_at, text_at, n = docs.columns.index("doc_id"), docs.columns.index("text"), len(docs.columns)

    def run(batches, schema):
        for b in C.slices(batches, text_at):
            each = [{np.array([x["h1"], x["h2"]], "<i8").tobytes(): x["first_doc"] for x in g or ()} for g in b.column(n).to_pylist()]
            yield C.record_batch([*b.columns[:n], _kept_column(b, id_at, text_at, each, keep_first, schema.field(n).type)], schema)

    return C.map_arrow(joined, run, C.with_field(docs.schema, name, KEPT))


def with_kept(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, index: LineIndex | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows as they are, with one more column, the last, of a name that they don't have: n_lines, n_dropped and the
    text left.

    Keys of at least min_docs documents lose all their lines, or all but the first in their first document where
    keep_first is set.  index is one kept from before, which then says what min_docs is; by default it is made here."""
    own = LineIndex.of(docs, min_docs) if index is None else index
    if own.nbytes() > broadcast_bytes:
        return _apply_routed(docs, own, keep_first, C.fresh(docs, "kept"))
    out = _apply_broadcast(docs, own, keep_first, C.fresh(docs, "kept"))
    if index is None:
        C.forget(own.table, own.found)
    return out


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, **more) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text left of every document; see with_kept."""
    out = with_kept(C.docs_of(docs), min_docs, keep_first, **more)
    return out.select("doc_id", F.col(out.columns[-1] + ".*"))
