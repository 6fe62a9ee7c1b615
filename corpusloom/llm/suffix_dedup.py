"""Suffix-array dedup: stretches of min_bytes bytes that occur elsewhere, found by longest-previous-factor arrays.

Every window of min_bytes bytes is filed under the smallest hash among its 32-byte grams; a run is a series of windows of
one text whose smallest hash is that of the same gram, the leftmost of equal ones.  Equal windows have that gram in the
same place, so the windows of one run differ, and a run whose hash occurs once holds no repeat.  Runs of one hash make a
block.  Copies don't go into the suffix order: texts that are equal, and runs that are equal as a whole, are known by
128-bit hashes of all their bytes and stand for one another; they are repeats as a whole.
The different runs of a block, where repeats begin or end, are put into suffix order, all their windows, by prefix
doubling; neighbours' common prefixes give, by the previous and the next smaller position in that order, each window's
longest previous factor (and, with positions turned round, its longest next one).  A window repeats if either reaches
min_bytes: bytes decide, not hashes.

A hash with very many different runs is dealt into blocks of BLOCK_RUNS; windows that repeat no earlier one in their block
then meet those of the other blocks in buckets by a 128-bit hash, BUCKET_WINDOWS in each.  Scans that come later learn by
bit maps of fixed size which hashes are worth sending; the joins behind them are exact, and a run that very many texts
hold is dealt to several tasks.  Texts that occur several times are sent once a task.

keep="none" removes every occurrence, keep="first" leaves the first one (smallest doc_id, then place).
Defined results: null texts are empty; texts under min_bytes stay; repeated rows are copies; with keep="first" a null
doc_id comes last, and rows that share the smallest doc_id all stay; columns besides id and text don't matter; a text of
any length is one value.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_BYTES = 200
GRAM = 32
BLOCK_RUNS = 512
BUCKET_WINDOWS = 1 << 18
CHUNK_BYTES = 1 << 18
FLUSH_TEXTS = 100_000
HOT_SHARE = 1000  # a run that more than this share of all has is dealt to several tasks; so no more than these are
BITS = 1 << 25
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_LAST = (1 << 62) + 1  # the place of an unknown doc_id in the order


def gram_hashes(x: np.ndarray, widths: set[int]) -> dict[int, np.ndarray]:
    """Hashes of all stretches of each power-of-two width, by doubling."""
    with np.errstate(over="ignore"):
        h = x.astype(np.uint64) + np.uint64(1)
        out, n, k = {1: h}, 1, 0
        while n < max(widths) and len(h) > n:
            h = h[:-n] * _M[k % 8] + h[n:]
            h ^= h >> np.uint64(29)
            n, k = 2 * n, k + 1
            out[n] = h
    return out


def run_names(text: bytes, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """A 128-bit name of each run's bytes, as two columns."""
    view = memoryview(text)
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:z]) for a, z in zip(first.tolist(), (last + size).tolist())]), "<i8").reshape(-1, 2)


def runs(text: bytes, size: int = MIN_BYTES):
    """(v, first, last): each run's smallest gram hash, its first and last window."""
    x = np.frombuffer(text, np.uint8)
    m = len(x) - size + 1
    if m < 1:
        return None
    with np.errstate(over="ignore"):
        least = gram_hashes(x, {GRAM})[GRAM] * _M[5]
        least ^= least >> np.uint64(32)
        least *= _M[6]
        span, n, gram = size - GRAM + 1, 1, least
        while 2 * n <= span:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        v = np.minimum(least[:m], least[span - n : span - n + m])
        first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (gram[: m - 1] == v[:-1])])
        last = np.r_[first[1:], m] - 1
    return v[first].view(np.int64), first, last


def name_of(text: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(text), "<i8").tolist())


def bit_of(v: np.ndarray) -> np.ndarray:
    u = v.view(np.uint64)
    return ((u ^ (u >> np.uint64(32))) & np.uint64(BITS - 1)).astype(np.int64)


def _marked(blob: bytes, at: np.ndarray) -> np.ndarray:
    return (np.frombuffer(blob, np.int64)[at >> 6] >> (at & 63)) & 1 == 1


def bit_map(rows: DataFrame, column: str) -> bytes:
    """BITS bits, one set for each value: 4 MB at every scale."""
    at = rows.selectExpr(f"(`{column}` ^ shiftrightunsigned(`{column}`, 32)) & {BITS - 1}L as b")
    found = at.selectExpr("shiftright(b, 6) as w", "shiftleft(1L, cast(b & 63 as int)) as m").groupBy("w").agg(F.bit_or("m").alias("m"))
    words = found.toArrow()  # BITS / 64 rows at most, in one job
    out = np.zeros(BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out.tobytes()


def smaller_neighbours(positions: np.ndarray) -> tuple[list[int], list[int]]:
    """In an order of suffixes, for each the nearest one before and after it whose position is smaller; -1 for none."""
    n, p = len(positions), positions.tolist()
    before, after, stack = [-1] * n, [-1] * n, []
    for k in range(n):
        while stack and p[stack[-1]] > p[k]:
            after[stack.pop()] = k
        if stack:
            before[k] = stack[-1]
        stack.append(k)
    return before, after


def longest_previous_factors(positions: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest match of each suffix with one at a smaller position; common[k] is the common prefix of k - 1 and k."""
    before, after = smaller_neighbours(positions)
    n = len(positions)
    levels = [np.r_[common, 0]]  # range minima by doubling
    while len(levels[-1]) > 1 << (len(levels) - 1) and 1 << len(levels) <= n:
        step, low = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(low[:-step], low[step:]))

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:  # of common[lo + 1 .. hi]
        width = hi - lo
        level = np.floor(np.log2(np.maximum(width, 1))).astype(int)
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(levels[k][lo[at] + 1], levels[k][hi[at] - (1 << k) + 1])
        return out

    out, here = np.zeros(n, np.int64), np.arange(n)
    for other, swap in ((np.array(before), False), (np.array(after), True)):
        at = np.flatnonzero(other >= 0)
        if len(at):
            lo, hi = (here[at], other[at]) if swap else (other[at], here[at])
            out[at] = np.maximum(out[at], least(lo, hi))
    return out


def ranks_of(x: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(width, rank) of the stretches that begin at every place, by their bytes: widths 8, 16, 32 ... and last size.

    Prefix doubling: a stretch is a pair of ranks of stretches half as long; the last pair overlaps."""

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        held = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.r_[0, held[1:] != held[:-1]])
        return rank

    n = len(x)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = x
    width = min(8, size)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key << np.uint64(8)) | wide[k : n + k]
    out = [(width, ranked(key))]
    while width < size:
        step = min(width, size - width)
        after = np.zeros(n, np.int64)
        after[: n - step] = out[-1][1][step:] + 1
        width += step
        out.append((width, ranked(out[-1][1] * (n + 1) + after)))
    return out


def common_prefixes(ranks: list[tuple[int, np.ndarray]], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many bytes the windows at p and q have in common: exact where it is size, else a lower bound, from the widest
    stretches down."""
    out, size = np.zeros(len(p), np.int64), ranks[-1][0]
    whole = ranks[-1][1][p] == ranks[-1][1][q]
    n = len(ranks[0][1])
    for width, rank in reversed(ranks[:-1]):
        a, b = np.minimum(p + out, n - 1), np.minimum(q + out, n - 1)
        out += np.where((out + width < size) & (rank[a] == rank[b]), width, 0)
    out[whole] = size
    return out


def repeated_windows(texts: list[bytes], size: int = MIN_BYTES) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text (earlier ones first): which windows repeat anywhere among the texts, and which repeat an earlier one.

    All windows are put into suffix order.  A window whose neighbours there share less than size bytes with it shares
    less with every other, so factors are worked out for those that touch a longer prefix."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    m = len(joined) - size + 1
    ranks = ranks_of(joined, size)
    inside = np.zeros(m, bool)
    for end, n in zip(ends.tolist(), lengths.tolist()):
        inside[end - n : end - size + 1] = True
    at = np.flatnonzero(inside)
    at = at[np.argsort(ranks[-1][1][at], kind="stable")]  # suffix order, equal windows by place
    same = ranks[-1][1][at[1:]] == ranks[-1][1][at[:-1]]
    at = at[np.r_[same, False] | np.r_[False, same]]
    any_, later = np.zeros(m, bool), np.zeros(m, bool)
    if len(at):
        common = np.r_[0, common_prefixes(ranks, at[1:], at[:-1])]
        later[at[longest_previous_factors(at, common) >= size]] = True
        any_ |= later
        any_[at[longest_previous_factors(-at, common) >= size]] = True
    cut = lambda a: [a[end - n : end - size + 1] for end, n in zip(ends.tolist(), lengths.tolist())]
    return cut(any_), cut(later)


def spans_of(flags: np.ndarray) -> np.ndarray:
    """(first, last) pairs of the set places, flat."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return np.column_stack([edge[::2], edge[1::2] - 1]).ravel().astype("<i4")


SURVEYED = "copies boolean, a long, b long, n long, low long, high long"


def survey(docs: DataFrame, size: int = MIN_BYTES) -> DataFrame:
    """One scan's two outputs, what occurs once left out: gram hashes a of all texts' runs, with the smallest and the
    largest name among their runs; and names (a, b) of texts that occur several times, with their smallest doc_id."""

    def run(batches, schema):
        C.release()
        seen: dict[tuple[int, int], list] = {}
        for b in C.slices(batches):
            v, g = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (t or "").encode()
                if len(raw) < size:
                    continue
                if (got := seen.get(name := name_of(raw))) is not None:
                    got[0] += 1
                    got[1] = i if got[1] is None or (i is not None and i < got[1]) else got[1]
                    continue
                seen[name] = [1, i]
                found = runs(raw, size)
                v.append(found[0])
                g.append(run_names(raw, found[1], found[2], size)[:, 0])
            if v:
                v, g = np.concatenate(v), np.concatenate(g)
                order = np.lexsort((g, v))
                v, g = v[order], g[order]
                head = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                tail = np.r_[head[1:], len(v)]
                yield C.record_batch([np.zeros(len(head), bool), v[head], np.zeros(len(head), np.int64), tail - head, g[head], g[tail - 1]], schema)
            if len(seen) >= FLUSH_TEXTS:
                yield C.record_batch([[True] * len(seen), *zip(*seen), *zip(*seen.values()), [x[1] for x in seen.values()]], schema)
                seen = {}
        if seen:
            yield C.record_batch([[True] * len(seen), *zip(*seen), *zip(*seen.values()), [x[1] for x in seen.values()]], schema)

    rows = C.map_arrow(docs, run, SURVEYED)
    return rows.groupBy("copies", "a", "b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1")


def candidates(docs: DataFrame, repeated: bytes, mixed: bytes, size: int = MIN_BYTES) -> DataFrame:
    """(v, g1, g2, t1, t2, place, first, last, content): the runs whose hash may repeat; bytes only where it may be mixed."""
    shared = docs.sparkSession.sparkContext.broadcast((repeated, mixed))

    def run(batches, schema):
        C.release()
        seen: set[tuple[int, int]] = set()
        for b in C.slices(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (t or "").encode()
                if len(raw) < size or (name := name_of(raw)) in seen:
                    continue
                seen.add(name)
                v, first, last = runs(raw, size)
                at = bit_of(v)
                hit = np.flatnonzero(_marked(shared.value[0], at))
                if not len(hit):
                    continue
                content = _marked(shared.value[1], at[hit])
                place = _LAST if i is None else i
                named = run_names(raw, first[hit], last[hit], size).tolist()
                rows += [(h, *g, *name, place, a, z, raw[a : z + size] if c else None) for h, g, c, a, z in zip(v[hit].tolist(), named, content.tolist(), first[hit].tolist(), last[hit].tolist())]
            if rows:
                yield C.record_batch(list(zip(*rows)), schema)

    return C.map_arrow(docs, run, "v long, g1 long, g2 long, t1 long, t2 long, place long, first int, last int, content binary")


RESOLVED = "g1 long, g2 long, any binary, later binary, bucket int, payload binary"
_RUN = np.dtype([("g1", "<i8"), ("g2", "<i8"), ("place", "<i8"), ("first", "<i4")])
_OPEN = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("run", "<i4"), ("at", "<i4")])


def resolve(edges: DataFrame, buckets: int, size: int = MIN_BYTES) -> DataFrame:
    """For runs (v, part, parts, g1, g2, place, first, content): the windows that repeat within their block, as spans; and
    of hashes in several blocks each window's first in its block, packed into buckets by the window's hash."""

    def settle(rows):
        rows.sort(key=lambda r: (r[5], r[6]))
        any_, later = repeated_windows([r[7] for r in rows], size)
        for r, a, b in zip(rows, any_, later):
            if a.any():
                yield r[3], r[4], spans_of(a).tobytes(), spans_of(b).tobytes(), None, None
        split = [k for k, r in enumerate(rows) if r[2] > 1]
        if split:
            entries = []
            for j, k in enumerate(split):
                at = np.flatnonzero(~later[k])  # a window that repeats an earlier one here is spoken for by that one
                e = np.zeros(len(at), _OPEN)
                view = memoryview(rows[k][7])
                named = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[p : p + size]) for p in at.tolist()]), "<u8").reshape(-1, 2)
                e["h1"], e["h2"], e["run"], e["at"] = named[:, 0], named[:, 1], j, at
                entries.append(e)
            e = np.concatenate(entries)
            table = np.array([(rows[k][3], rows[k][4], rows[k][5], rows[k][6]) for k in split], _RUN)
            bucket = (e["h1"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else np.zeros(1, int)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = e[order[x:y]]
                used, part["run"] = np.unique(part["run"], return_inverse=True)
                head = np.array([len(used)], "<i8").tobytes()
                yield None, None, None, None, int(bucket[order[x]]), head + table[used].tobytes() + part.tobytes()

    def run(batches, schema):
        C.release()
        held: list[tuple] = []
        weight = 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(8))):
                if weight >= CHUNK_BYTES and held[-1][:2] != row[:2]:
                    if out := list(settle(held)):
                        yield C.record_batch(list(zip(*out)), schema)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[7])
        if held and (out := list(settle(held))):
            yield C.record_batch(list(zip(*out)), schema)

    n = C.partitions(edges.sparkSession)
    rows = edges.select("v", "part", "parts", "g1", "g2", "place", "first", "content")
    return C.map_arrow(rows.repartition(n, "v", "part").sortWithinPartitions("v", "part"), run, RESOLVED)


def resolve_across(packed: DataFrame) -> DataFrame:
    """(g1, g2, any, later): windows that repeat between blocks.  A bucket holds all windows of its hashes."""

    def settle(payloads: list[bytes]):
        runs_, entries, n = [], [], 0
        for x in payloads:
            k = int(np.frombuffer(x, "<i8", 1)[0])
            runs_.append(np.frombuffer(x, _RUN, k, 8))
            e = np.frombuffer(x, _OPEN, -1, 8 + k * _RUN.itemsize).copy()
            e["run"] += n
            n += k
            entries.append(e)
        r, e = np.concatenate(runs_), np.concatenate(entries)
        place, first = r["place"][e["run"]], r["first"][e["run"]].astype(np.int64) + e["at"]
        e = e[(order := np.lexsort((first, place, e["h2"], e["h1"])))]
        place, first = place[order], first[order]
        same = (e["h1"][1:] == e["h1"][:-1]) & (e["h2"][1:] == e["h2"][:-1])
        met = np.r_[same, False] | np.r_[False, same]
        head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(e)), 0))
        later = met & ((place != place[head]) | (first != first[head]))
        order = np.lexsort((e["at"], e["run"]))
        order = order[met[order]]
        run, at, later = e["run"][order], e["at"][order], later[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(run) != 0, True]) if len(run) else np.zeros(1, int)
        pairs = lambda a: np.repeat(a, 2).astype("<i4").tobytes()
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(r["g1"][run[x]]), int(r["g2"][run[x]]), pairs(at[x:y]), pairs(at[x:y][later[x:y]])

    def one(batches, schema):
        C.release()
        now, held = None, []
        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and bucket != now:
                    if out := list(settle(held)):
                        yield C.record_batch(list(zip(*out)), schema)
                    held = []
                now = bucket
                held.append(payload)
        if held and (out := list(settle(held))):
            yield C.record_batch(list(zip(*out)), schema)

    n = C.partitions(packed.sparkSession)
    rows = packed.select("bucket", "payload").repartition(n, "bucket").sortWithinPartitions("bucket")
    return C.map_arrow(rows, one, "g1 long, g2 long, any binary, later binary")


def repeats(docs: DataFrame, seen: DataFrame, size: int = MIN_BYTES, keep: str = "none") -> DataFrame:
    """(t1, t2, runs): of each text with repeats, the runs with windows to be removed; see windows_of.  seen is a survey."""
    grams = seen.where("not copies")
    found = C.stash(candidates(docs, bit_map(grams, "a"), bit_map(grams.where("low <> high"), "a"), size))
    kinds = C.stash(found.groupBy("g1", "g2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min(F.struct("place", "first")).alias("at"), F.first("last").alias("last"), F.first("content", ignorenulls=True).alias("content"), F.min(F.col("last") - F.col("first")).alias("width")))
    sums = kinds.groupBy("v").agg(F.count("*").alias("k")).where("k > 1").withColumn("parts", F.ceil(F.col("k") / BLOCK_RUNS).cast("int"))
    edges = kinds.where("content is not null").join(sums, "v").select("v", "g1", "g2", F.pmod(F.col("g1"), F.col("parts")).cast("int").alias("part"), "parts", F.col("at.place").alias("place"), F.col("at.first").alias("first"), "content")
    open_ = edges.where("parts > 1").agg(F.sum(F.length("content") - size + 1).alias("n")).first()["n"] or 0
    solved = C.stash(resolve(edges, max(1, math.ceil(open_ / BUCKET_WINDOWS)), size))
    parts = solved.where("bucket is null").select("g1", "g2", "any", "later")
    if open_:
        parts = parts.unionByName(resolve_across(solved.where("bucket is not null")))
    spans = F.col("later" if keep == "first" else "any")
    none = lambda kind: F.lit(None).cast(kind)
    whole = kinds.where("n > 1").select("g1", "g2", "width", F.col("at.place").alias("own"), F.col("at.first").alias("own_first"), none("binary").alias("s"))
    some = parts.where(F.length(spans) > 0).select("g1", "g2", none("int").alias("width"), none("long").alias("own"), none("int").alias("own_first"), spans.alias("s"))
    told = whole.unionByName(some).groupBy("g1", "g2").agg(F.max("width").alias("width"), F.max("own").alias("own"), F.max("own_first").alias("own_first"), F.collect_list("s").alias("spans"))
    lean = found.select("g1", "g2", "t1", "t2", "place", "first")
    if keep == "first":  # of a text's copies, that of the smallest doc_id speaks for it
        lean = lean.join(lean.groupBy("t1", "t2").agg(F.min("place").alias("place")), ["t1", "t2", "place"], "left_semi")
    # a run that very many texts hold: its rows are dealt to several tasks, and what is told of it goes to each
    least = max(1000, (kinds.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT_SHARE)
    hot = F.broadcast(kinds.where(F.col("n") > least).select("g1", "g2", F.ceil(F.col("n") / least).cast("int").alias("deals")))
    deals = F.coalesce("deals", F.lit(1))
    lean = lean.join(hot, ["g1", "g2"], "left").withColumn("deal", F.pmod(F.xxhash64("t1", "t2", "first"), deals).cast("int")).drop("deals")
    told = told.join(hot, ["g1", "g2"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    both = lean.join(told, ["g1", "g2", "deal"])
    if keep == "first":
        own = (F.col("place") == F.col("own")) & (F.col("first") == F.col("own_first"))
        both = both.withColumn("width", F.when(~F.coalesce(own, F.lit(False)), F.col("width")))
    both = both.where("width is not null or size(spans) > 0")
    return both.groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "width", "spans")).alias("runs"))


def windows_of(found) -> list[tuple[int, int]]:
    """(first, last) windows of a text's runs: whole ones by their width, others by their packed spans."""
    out = []
    for r in found:
        at = int(r["first"])
        if r["width"] is not None:
            out.append((at, at + int(r["width"])))
        else:
            out += [(at + a, at + z) for x in r["spans"] for a, z in np.frombuffer(x, "<i4").reshape(-1, 2).tolist()]
    return out


def remove(text: bytes, spans, size: int = MIN_BYTES) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs and the bytes left; spans are (first, last) windows."""
    if spans is None or not len(spans):
        return 0, 0, text
    cuts: list[list[int]] = []
    for a, z in sorted(spans):
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], z + size)
        else:
            cuts.append([a, z + size])
    left, at = [], 0
    for a, z in cuts:
        left.append(text[at:a])
        at = z
    left.append(text[at:])
    return sum(z - a for a, z in cuts), len(cuts), b"".join(left)


FIELDS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def dedup(docs: DataFrame, size: int = MIN_BYTES, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept of every document."""
    docs = C.docs_of(docs)
    seen = C.stash(survey(docs, size))
    spans = repeats(docs, seen, size, keep)
    none = lambda kind: F.lit(None).cast(kind)
    copies = seen.where("copies").select(F.col("a").alias("t1"), F.col("b").alias("t2"), none(spans.schema["runs"].dataType).alias("runs"), F.col("low").alias("own"), F.lit(True).alias("copies"))
    marks = spans.select("t1", "t2", "runs", none("long").alias("own"), F.lit(False).alias("copies")).unionByName(copies)
    marks = C.stash(marks.groupBy("t1", "t2").agg(F.first("runs", ignorenulls=True).alias("runs"), F.min("own").alias("own"), F.max("copies").alias("copies")))
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(marks, "t1"))

    def told_apart(wanted: bool):
        """Texts that may be marked, as they are, with their names; or the rows of those that are not."""

        def run(batches, schema):
            C.release()
            for b in C.slices(batches):
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = (t or "").encode()
                    name = name_of(raw)
                    if bool(_marked(shared.value, bit_of(np.array(name[:1], np.int64)))[0]) == wanted:
                        rows.append((i, *name, raw) if wanted else (i, len(raw), 0, 0, raw))
                if rows:
                    yield C.record_batch(list(zip(*rows)), schema)

        return C.map_arrow(docs, run, "doc_id long, t1 long, t2 long, raw binary" if wanted else FIELDS)

    def cut(batches, schema):
        for b in C.slices(batches, 1):
            rows = []
            for i, raw, found, own, copied in zip(*(b.column(k).to_pylist() for k in range(5))):
                at = None if found is None else windows_of(found)
                stays = keep == "first" and own is not None and i == own
                if copied is True and not stays:
                    at = [(0, len(raw) - size)]
                rows.append((i, len(raw), *remove(raw, at, size)))
            yield C.record_batch(list(zip(*rows)), schema)

    joined = told_apart(True).join(marks, ["t1", "t2"], "left").select("doc_id", "raw", "runs", "own", "copies")
    return C.map_arrow(joined, cut, FIELDS).unionByName(told_apart(False))
