"""N-gram Jaccard join as a blocked product of the document by n-gram incidence matrix with itself.

A document's set is that of its distinct five-word shingles, hashed to 64 bits.  Documents with equal sets are one
row of the matrix (a class, named by 128 bits), so copies never meet.  The product runs over two blocks of columns:

1. Prefix columns.  Under one global order of the shingles, two sets with Jaccard num/den or more share a column
   among each one's first n - ceil(n * num / den) + 1.  Only these columns are multiplied.  The order puts frequent
   shingles last (any order is valid; this one keeps shared passages out of the prefixes).  Columns travel packed:
   a task sorts its rows by shingle and sends each bucket of shingles differences and small numbers, not rows; shingles
   are cut to as many bits as the number of rows asks for, since a wrong meeting costs a test and no more.
2. All columns, for the pairs that are left: bucket counts of the sets bound the overlap, and what they let pass is
   settled by the whole sets, made from texts that are sent to the blocks where they are asked for.

What is asked for is components, so a column with many documents isn't multiplied out: its documents meet the one
with the fewest rare shingles of their size class, these pairs are settled, and only columns whose documents still
lie in different components are then multiplied in full, in blocks, across components.  No bound is put on partners.

Defined results: null, empty and blank texts have an empty set and link with nothing; with fewer than five words
the whole sequence is the one shingle; repeated rows are copies; a row without a doc_id links like any other, but
names no component: component_id is the smallest doc_id that links reach, null where none of them has one; columns
besides id and text don't matter; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS, NUM, DEN = 5, 3, 4
HOT_MIN, HOT_MOST = 16, 1 << 18  # a shingle put last; how many at most, as they are broadcast (2 MB)
SMALL = 16  # columns of up to so many classes are multiplied in full at once
CHUNK_ROWS = 1 << 19  # matrix entries that a task sorts and packs at once
BUCKET_ROWS = 1 << 20  # entries of one bucket of shingles, about
SPARE_BITS = 10  # a cut shingle has so many bits more than the number of entries
CELL = 2048  # rows of a wide column that one task multiplies with as many others
KNOWN = 16  # earlier columns of a class by which a pair is known to have been found
CELL_PAIRS = 1000  # pairs that two blocks of rows have, about
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)
_SPACE = np.isin(np.arange(256), list(C.SPACE.encode()))
CHUNK = 1 << 20  # bytes of text that are hashed at once


def batch_shingles(texts) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each whole text; bytes of about CHUNK are hashed together."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode().lower() if isinstance(t, str) else b""  # bytes: A-Z alone is lowered
        held.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield from _shingle(held)
            held, size = [], 0
    yield from _shingle(held)


def _shingle(raw: list[bytes]) -> Iterator[np.ndarray]:
    if not raw:
        return
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    word = ~_SPACE[b]
    turn = np.diff(np.r_[0, word.view(np.int8), 0])
    starts = np.flatnonzero(turn == 1)
    lengths = np.flatnonzero(turn == -1) - starts
    ends_at = np.cumsum([len(x) + 1 for x in raw])
    cut = np.r_[0, np.searchsorted(starts, ends_at)]
    with np.errstate(over="ignore"):
        if len(starts):
            first = np.r_[0, np.cumsum(lengths)[:-1]]
            powers = np.cumprod(np.full(int(lengths.max()), _STEP))
            place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            h = mix(np.add.reduceat(_BYTE[b[word]] * powers[place], first) ^ (lengths.astype(np.uint64) * _POWERS[1]))
            total = h * _POWERS[0]
            for k in range(1, min(WORDS, len(h))):
                total[: len(h) - k] += h[k:] * _POWERS[k]
            total = mix(total).view(np.int64)
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            n = z - a
            if n >= WORDS:
                yield np.unique(total[a : z - WORDS + 1])
            elif n:
                yield mix((h[a:z] * _POWERS[:n]).sum(keepdims=True) + np.uint64(n)).view(np.int64)
            else:
                yield np.empty(0, np.int64)


def shingles(text: str | None) -> np.ndarray:
    return next(batch_shingles([text]))


def name_of(raw: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8").tolist())


def class_of(found: np.ndarray, clashes: frozenset = frozenset()) -> int:
    """A set's class: half of its 128-bit name, the other half where the first one stands for several sets."""
    a, b = name_of(found.tobytes())
    return b if a in clashes else a


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-n * num // den) + 1


def prefix(found: np.ndarray, hot: np.ndarray | None, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The first shingles under the global order: rare ones by hash, then frequent ones by hash."""
    p = prefix_length(len(found), num, den)
    if hot is None or not len(hot):
        return found[:p]
    at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
    last = hot[at] == found
    cold = found[~last]
    return cold[:p] if len(cold) >= p else np.concatenate([cold, found[last][: p - len(cold)]])


PROFILE = "doc_id long, n long, c long, c2 long, t1 long, t2 long, counts binary, s long, often long"


def profile(docs: DataFrame) -> DataFrame:
    """One scan's two outputs: (doc_id, n, c, c2, t1, t2, counts) of every document, counts with a class's first
    document of the task alone; and (s, often): shingles that a task saw in several classes at a time.

    All shingles are counted, not those of prefixes alone: as frequent ones are put last, prefixes reach further."""

    def run(batches, schema):
        C.release()
        known: set[tuple[int, int]] = set()
        firsts: list[np.ndarray] = []

        def several():
            for r in range(8):  # an eighth of the shingles at a time, to sort less at once
                value, count = np.unique(np.concatenate([s[s & 7 == r] for s in firsts]), return_counts=True)
                value, count = value[count > 1], count[count > 1]
                yield C.record_batch([*([None] * len(value),) * 7, value, count], schema)

        for b in C.slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for i, t, s in zip(ids, texts, batch_shingles(texts)):
                name = name_of(s.tobytes())
                new = len(s) > 0 and name not in known
                if new:
                    known.add(name)
                    firsts.append(s)
                rows.append((i, len(s), *name, *name_of((t or "").encode()), counts_of(s) if new else None, None, None))
            yield C.record_batch(list(zip(*rows)), schema)
            if sum(map(len, firsts)) >= CHUNK_ROWS:
                yield from several()
                firsts = []
        if firsts:
            yield from several()

    return C.map_arrow(C.docs_of(docs), run, PROFILE)


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, the empty ones left out; high planes hold little and compress well."""
    x = x.astype("<u8")
    used = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([used]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :used].T).tobytes()


def _unplanes(blob: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    used = blob[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(blob, np.uint8, used * n, at + 1).reshape(used, n).T
    return out.view("<u8").ravel(), at + 1 + used * n


def pack(s: np.ndarray, who: np.ndarray, place: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> bytes:
    """A bucket's entries, sorted by s (cut shingles): their classes as numbers in a table of the classes that occur."""
    used, short = np.unique(who, return_inverse=True)
    blob = b"".join(map(planes, (np.diff(s, prepend=s.dtype.type(0)), short, place, classes[used].view(np.uint64), sizes[used])))
    return np.array([len(s), len(used), len(blob)], "<i8").tobytes() + pa.compress(blob, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(s, c, n, i) of a bucket's entries."""
    m, k, size = np.frombuffer(packed, "<i8", 3).tolist()
    view = memoryview(pa.decompress(packed[24:], size, codec="zstd", asbytes=True))
    at, out = 0, []
    for n in (m, m, m, k, k):
        x, at = _unplanes(view, at, n)
        out.append(x)
    step, short, place, classes, sizes = out
    return np.cumsum(step, dtype=np.uint64), classes.view(np.int64)[short], sizes[short].astype(np.int64), place.astype(np.int64)


ENTRIES = "bucket int, payload binary, s long, c long, n long, i long"


def incidence(docs: DataFrame, hot: np.ndarray, clashes: frozenset, buckets: int, bits: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """Prefix entries of the matrix, class c of n shingles having shingle s in place i: packed ones by bucket, and
    those of frequent shingles as rows, dealt to any bucket.  A task sends a class once."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches, schema):
        C.release()
        known: set[int] = set()
        rows: list[tuple] = []
        size = 0

        def packed():
            s = np.concatenate([r[0] for r in rows]).view(np.uint64)
            lengths = [len(r[0]) for r in rows]
            classes, sizes = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            who, place = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.arange(x) for x in lengths])
            often = np.zeros(len(s), bool)
            if len(shared.value):
                often = shared.value[np.minimum(np.searchsorted(shared.value, s.view(np.int64)), len(shared.value) - 1)] == s.view(np.int64)
            at = np.flatnonzero(often)
            if len(at):
                c = classes[who[at]]
                yield C.record_batch([(c % buckets).astype(np.int32), pa.nulls(len(at), pa.binary()), s[at].view(np.int64), c, sizes[who[at]], place[at]], schema)
            at = np.flatnonzero(~often)
            at = at[np.argsort(s[at])]
            cut = s[at] >> np.uint64(64 - bits)
            bucket = (s[at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True]).tolist() if len(at) else [0]
            none = lambda n: pa.nulls(n, pa.int64())
            for a, z in zip(cuts, cuts[1:]):
                blob = pack(cut[a:z], who[at[a:z]], place[at[a:z]], classes, sizes)
                yield C.record_batch([[int(bucket[a])], [blob], *(none(1) for _ in range(4))], schema)

        for b in C.slices(batches):
            for s in batch_shingles(b.column(1).to_pylist()):
                if not len(s) or (c := class_of(s, clashes)) in known:
                    continue
                known.add(c)
                rows.append((prefix(s, shared.value, num, den), c, len(s)))
                size += len(rows[-1][0])
                if size >= CHUNK_ROWS:
                    yield from packed()
                    rows, size = [], 0
        if rows:
            yield from packed()

    return C.map_arrow(C.docs_of(docs), run, ENTRIES)


def _possible(n1, i1, n2, i2, num: int, den: int):
    """Whether sizes and places leave room for the overlap that the threshold asks; of arrays or columns."""
    least, most = (np.minimum, np.maximum) if isinstance(n1, np.ndarray) else (F.least, F.greatest)
    need = num * (n1 + n2)
    return (den * least(n1, n2) >= num * most(n1, n2)) & (least(n1 - i1, n2 - i2) * (num + den) >= need)


MET = "a long, b long, na long, nb long, k long, big boolean"


def multiply(entries: DataFrame, buckets: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b, na, nb, k): pairs that meet, their sizes and in how many of the columns multiplied in full, big false;
    and the entries of the other columns, as a = class, b = shingle, na = n and nb = i, big true."""

    def product(blobs, schema):
        s, c, n, i = (np.concatenate(x) for x in zip(*map(unpack, blobs)))
        order = np.lexsort((i, c, s))
        s, c, n, i = s[order], c[order], n[order], i[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (i[1:] != i[:-1])]  # several tasks may send a class
        s, c, n, i = s[new], c[new], n[new], i[new]
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s)])
        each = np.repeat(size, size)
        keep = np.flatnonzero((each > 1) & (each <= SMALL))
        got = []
        for d in range(1, SMALL):
            x, y = keep[:-d], keep[d:]
            same = s[x] == s[y]
            x, y = x[same], y[same]
            if not len(x):
                break
            ok = den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])  # by size alone: places would spoil the count
            ok &= c[x] != c[y]  # two shingles of a class that are one when cut
            got.append(np.stack([c[x[ok]], c[y[ok]], n[x[ok]], n[y[ok]]]))
        if got:
            a, b, na, nb = np.concatenate(got, axis=1)
            order = np.lexsort((b, a))
            a, b, na, nb = a[order], b[order], na[order], nb[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, int)
            k = np.diff(np.r_[first, len(a)])
            yield C.record_batch([a[first], b[first], na[first], nb[first], k, np.zeros(len(first), bool)], schema)
        wide = np.flatnonzero(each > SMALL)
        if len(wide):
            yield C.record_batch([c[wide], s[wide].view(np.int64), n[wide], i[wide], np.zeros(len(wide), np.int64), np.ones(len(wide), bool)], schema)

    def run(batches, schema):
        C.release()
        now, held = None, []
        for b in batches:
            bucket = b.column(0).to_numpy()
            whole = b.column(1).is_null().to_numpy(zero_copy_only=False)
            if whole.any():
                x = b.filter(pa.array(whole))
                yield C.record_batch([x.column(3), x.column(2), x.column(4), x.column(5), np.zeros(x.num_rows, np.int64), np.ones(x.num_rows, bool)], schema)
            for k in np.flatnonzero(~whole).tolist():
                if held and bucket[k] != now:
                    yield from product(held, schema)
                    held = []
                now = bucket[k]
                held.append(b.column(1)[k].as_py())
        if held:
            yield from product(held, schema)

    return C.map_arrow(entries.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, MET)


def meetings(met: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b, na, nb, k) of all pairs so far: counted ones, and in each wide column every class with the one of fewest
    rare shingles among its size class and among the next smaller one."""
    big = met.where("big").select(F.col("b").alias("s"), F.col("a").alias("c"), F.col("na").alias("n"), F.col("nb").alias("i"))
    big = big.withColumn("level", F.floor(F.log("n") / math.log(den / num)))
    least = big.groupBy("s", "level").agg(F.min(F.struct("i", F.xxhash64("c").alias("h"), "c", "n")).alias("to"))
    least = least.unionByName(least.withColumn("level", F.col("level") + 1))
    other = [F.col("to.n").alias("n2"), F.col("to.i").alias("i2"), F.col("to.c").alias("c2")]
    both = big.join(least, ["s", "level"]).select("c", "n", "i", *other).where("c <> c2")
    both = both.where(_possible(F.col("n"), F.col("i"), F.col("n2"), F.col("i2"), num, den))
    first = F.col("c") < F.col("c2")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    led = both.select(pick("c", "c2", "a"), pick("c2", "c", "b"), pick("n", "n2", "na"), pick("n2", "n", "nb"), F.lit(0).cast("long").alias("k"))
    return met.where("not big").select("a", "b", "na", "nb", "k").unionByName(led)


def wide_counts(met: DataFrame) -> DataFrame:
    """(c, w): in how many columns that are not multiplied in full a class has an entry."""
    return met.where("big").groupBy(F.col("a").alias("c")).agg(F.count_distinct("b", "nb").alias("w"))


def _most(k, wa, wb, na, nb, num: int, den: int):
    """What an overlap is at most: shingles counted, those in columns not multiplied in full, of which a pair shares no
    more than either class has, and those beyond the prefix that ends first."""
    if isinstance(na, np.ndarray):
        rest = lambda n: -(-n * num // den) - 1
        return k + np.minimum(wa, wb) + np.maximum(rest(na), rest(nb))
    rest = lambda n: F.ceil(n * num / den) - 1
    return k + F.least(wa, wb) + F.greatest(rest(na), rest(nb))


def prune(met: DataFrame, wide: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b) whose overlap may still reach the threshold."""
    pairs = meetings(met, num, den).groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    out = pairs.join(wide.toDF("a", "wa"), "a", "left").join(wide.toDF("b", "wb"), "b", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    na, nb = F.col("na"), F.col("nb")
    return out.where(_most(F.col("k"), zero("wa"), zero("wb"), na, nb, num, den) * (num + den) >= num * (na + nb)).select("a", "b")


def multiply_across(rows: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs of a column whose classes lie in different components and may reach the threshold, for rows
    (s, c, n, i, w, component).  A pair that met in columns multiplied in full was judged there, so none is counted here.

    A column of more than CELL classes is dealt into blocks of rows, and each block meets each in a task of its own.
    Each row has its class's first KNOWN columns before its own, and a pair that shares one of them was found there."""
    first = rows.groupBy("c").agg(F.slice(F.array_sort(F.collect_set(F.struct("i", "s"))), 1, KNOWN).alias("first"))
    sized = rows.join(rows.groupBy("s").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks")), "s").join(first, "c")
    before = F.transform(F.filter("first", lambda x: x["i"] < F.col("i")), lambda x: x["s"])
    sized = sized.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("s", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "c", "n", "i", "w", "component", before.alias("before"))

    def cell(held, schema):
        x, y, side, c, n, i, w, comp = (np.concatenate(z) for z in zip(*(h[:-1] for h in held)))
        before = [z for h in held for z in h[-1]]
        lengths = np.fromiter(map(len, before), np.int64, len(before))
        flat, owner = np.concatenate([np.asarray(z, np.int64) for z in before]), np.repeat(np.arange(len(before)), lengths)
        got, size = [], 0
        for k in range(len(c)) if x[0] == y[0] else np.flatnonzero(side == 0).tolist():
            at = np.arange(k + 1, len(c)) if x[0] == y[0] else np.flatnonzero(side)
            at = at[(comp[at] != comp[k]) & _possible(n[at], i[at], n[k], i[k], num, den)]
            at = at[_most(0, w[at], w[k], n[at], n[k], num, den) * (num + den) >= num * (n[at] + n[k])]
            if len(at) and lengths[k]:
                found = np.zeros(len(c), bool)
                found[owner[np.isin(flat, before[k])]] = True
                at = at[~found[at]]
            got.append((np.minimum(c[at], c[k]), np.maximum(c[at], c[k])))
            size += len(at)
            if size >= 1 << 16:
                yield C.record_batch([np.concatenate(z) for z in zip(*got)], schema)
                got, size = [], 0
        if size:
            yield C.record_batch([np.concatenate(z) for z in zip(*got)], schema)

    def run(batches, schema):
        now, held = None, []
        for b in batches:
            columns = [b.column(k).to_numpy() for k in range(9)]
            known = b.column(9).to_pylist()
            cuts = _cuts(columns[:3])
            for a, z in zip(cuts, cuts[1:]):
                key = tuple(int(q[a]) for q in columns[:3])
                if held and key != now:
                    yield from cell(held, schema)
                    held = []
                now = key
                held.append((*(q[a:z] for q in columns[1:]), known[a:z]))
        if held:
            yield from cell(held, schema)

    parts = C.partitions(rows.sparkSession)
    return C.map_arrow(dealt.repartition(parts, "s", "x", "y").sortWithinPartitions("s", "x", "y"), run, "a long, b long").distinct()


def _cuts(keys: list[np.ndarray]) -> list[int]:
    """Where any of the keys changes, with both ends."""
    n = len(keys[0])
    turn = np.zeros(max(0, n - 1), bool)
    for k in keys:
        turn |= k[1:] != k[:-1]
    return [0, *(np.flatnonzero(turn) + 1).tolist(), n] if n else [0]


BITS = 1 << 25


def wanted_texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(t1, t2, text) of the texts named, and of few others, each once a task: by a bit map of fixed size, without a
    shuffle.  A join after it is exact."""
    shared = docs.sparkSession.sparkContext.broadcast(C.id_bits(named, "t1", BITS))

    def run(batches, schema):
        C.release()
        marks, known = np.frombuffer(shared.value, np.int64), set()
        for b in C.slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                name = name_of((t or "").encode())
                at = name[0] & (BITS - 1)
                if marks[at >> 6] >> (at & 63) & 1 and name not in known:
                    known.add(name)
                    rows.append((*name, t))
            if rows:
                yield C.record_batch(list(zip(*rows)), schema)

    return C.map_arrow(C.docs_of(docs), run, "t1 long, t2 long, text string")


def counts_of(found: np.ndarray) -> bytes:
    """The set's size and how many shingles fall into each of about size / 2 buckets: a sixteenth of the set's bytes."""
    k = max(6, int(len(found)).bit_length() - 2)
    counts = np.bincount((found.view(np.uint64) >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return len(found).to_bytes(8, "little") + counts.astype("<u2").clip(0, 255).astype(np.uint8).tobytes()


def may_link(x: bytes, y: bytes, num: int, den: int) -> bool:
    """Whether the buckets leave room: an overlap is at most the sum of the smaller counts."""
    u, v = np.frombuffer(x, np.uint8, -1, 8), np.frombuffer(y, np.uint8, -1, 8)
    if max(u.max(), v.max()) == 255:  # the count may be larger
        return True
    low = min(len(u), len(v))
    u, v = (a.reshape(low, -1).sum(1) if len(a) > low else a for a in (u, v))
    n = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
    return (num + den) * int(np.minimum(u, v).sum()) >= num * n


def link(u: np.ndarray, v: np.ndarray, num: int, den: int) -> bool:
    return (num + den) * len(np.intersect1d(u, v, assume_unique=True)) >= num * (len(u) + len(v))


def blocks_for(pairs: int, parts: int) -> int:
    """Blocks of rows, so that two of them have CELL_PAIRS pairs at most on average, and all tasks something to do."""
    return max(1, min(math.isqrt(pairs // 64), max(math.isqrt(pairs // CELL_PAIRS), math.isqrt(2 * parts))))


def block_product(pairs: DataFrame, rows: DataFrame, data: str, test, named: DataFrame | None = None) -> DataFrame:
    """The (a, b) of pairs that pass a test, by a product in blocks.

    rows hold each class's data under c, or under t1 and t2, which named gives for each c.  Classes are dealt into blocks
    by a hash.  A task multiplies a block by a block; data travels once for each block that it meets, however many
    partners it has there.  Neither side is of bounded size, so neither is broadcast."""
    blocks = blocks_for(pairs.count(), C.partitions(rows.sparkSession))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    asked = pairs.select("a", "b", block("a").alias("x"), block("b").alias("y"))
    at = F.col("x").alias("row"), F.col("y").alias("col")
    uses = asked.select(F.col("a").alias("c"), *at).unionByName(asked.select(F.col("b").alias("c"), *at)).distinct()
    keys = ["c"]
    if named is not None:
        uses, keys = uses.join(named, "c"), ["t1", "t2"]
    sent = uses.join(rows.hint("shuffle_merge"), keys).select("c", "row", "col", data)

    def product(p: pa.Table, s: pa.Table) -> pa.Table:
        held: dict = {}
        for c, d in zip(s["c"].to_pylist(), s[data].to_pylist()):
            held.setdefault(c, d)
        return test(p["a"].to_pylist(), p["b"].to_pylist(), held)

    return C.stash(asked.groupBy("x", "y").cogroup(sent.groupBy("row", "col")).applyInArrow(product, "a long, b long"))


def asked_for(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among those wanted, and few others: by a bit map of fixed size, without a shuffle."""
    shared, at = rows.sparkSession.sparkContext.broadcast(C.id_bits(wanted, key, BITS)), rows.columns.index(key)

    def run(batches, schema):
        marks = np.frombuffer(shared.value, np.int64)
        for b in batches:
            low = b.column(at).to_numpy() & (BITS - 1)
            yield b.filter(pa.array(marks[low >> 6] >> (low & 63) & 1 == 1))

    return C.map_arrow(rows, run, rows.schema)


def settle(docs: DataFrame, profiles: DataFrame, named: DataFrame, pairs: DataFrame, clashes: frozenset, num: int = NUM, den: int = DEN) -> DataFrame:
    """The (a, b) whose whole overlap reaches the threshold: first by bucket counts, which bound it, then by the sets."""

    def table(found):
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    def bounded(a, b, counts):
        return table([(x, y) for x, y in zip(a, b) if may_link(counts[x], counts[y], num, den)])

    def whole(a, b, texts):
        sets = dict(zip(texts, batch_shingles(texts.values())))
        if any(class_of(s, clashes) != c for c, s in sets.items()):
            raise RuntimeError("a class is held against another text's set")
        return table([(x, y) for x, y in zip(a, b) if link(sets[x], sets[y], num, den)])

    of = lambda p: p.select(F.col("a").alias("c")).unionByName(p.select(F.col("b").alias("c")))
    counts = asked_for(profiles.where("counts is not null").select("c", "counts"), "c", of(pairs)).groupBy("c").agg(F.first("counts").alias("counts"))
    near = block_product(pairs, counts, "counts", bounded)
    if not near.head(1):
        return near
    wanted = C.stash(named.join(of(near).distinct(), "c", "left_semi"))
    out = block_product(near, wanted_texts(docs, wanted), "text", whole, wanted)
    C.forget(near, wanted)
    return out


def classes(docs: DataFrame, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, c, t1, t2) of every row, (c, own) with each class's smallest doc_id, and (c, component, component_id)
    of every class that links with another, component being a class."""
    both = C.stash(profile(docs))
    rows = both.where("n is not null")
    sums = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("own"), F.min(F.struct("t1", "t2")).alias("t"), F.min("c2").alias("low"), F.max("c2").alias("high"), F.first("n").alias("n"))
    names = C.stash(sums)
    clashes = frozenset(r["c"] for r in names.where("low <> high").select("c").collect())
    if clashes:  # halves of names that stand for several sets; about one in 2^64 / classes, so the list is short
        rows = rows.withColumn("c", F.when(F.col("c").isin(*clashes), F.col("c2")).otherwise(F.col("c")))
        C.forget(names)
        names = C.stash(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("own"), F.min(F.struct("t1", "t2")).alias("t"), F.first("n").alias("n")))
    named = names.select("c", "t.t1", "t.t2")
    often = C.stash(both.where("s is not null").groupBy("s").agg(F.sum("often").alias("n")).where(F.col("n") >= HOT_MIN))
    hot = C.most_frequent(often, HOT_MOST)
    hot = np.sort(np.array([r["s"] for r in hot.select("s").collect()], np.int64))
    entries = names.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1).alias("n")).first()["n"] or 1
    buckets = max(C.partitions(docs.sparkSession), math.ceil(entries / BUCKET_ROWS))
    bits = min(64, max(32, int(entries).bit_length() + SPARE_BITS))
    met = C.stash(multiply(incidence(docs, hot, clashes, buckets, bits, num, den), buckets, num, den))
    wide = C.stash(wide_counts(met))
    pairs = C.stash(prune(met, wide, num, den))
    edges = settle(docs, rows, named, pairs, clashes, num, den)
    comp, last = C.connected_components(edges)
    big = met.where("big").select(F.col("b").alias("s"), F.col("a").alias("c"), F.col("na").alias("n"), F.col("nb").alias("i")).join(wide, "c")
    big = big.join(comp.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    open_columns = big.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("s")
    left = C.stash(big.join(open_columns, "s", "left_semi"))
    more = C.stash(multiply_across(left, num, den).join(pairs, ["a", "b"], "left_anti"))
    found = None
    if more.head(1):
        found = settle(docs, rows, named, more, clashes, num, den)
        if found.head(1):
            C.forget(last)
            comp, last = C.connected_components(edges.unionByName(found))
    own = names.select("c", "own")
    linked = comp.withColumnRenamed("node", "c").unionByName(comp.select(F.col("component").alias("c"), "component")).distinct().join(own, "c")
    least = linked.groupBy("component").agg(F.min("own").alias("component_id"))
    out = C.stash(linked.join(least, "component").select("c", "component", "component_id"))
    C.forget(often, met, wide, left, pairs, edges, more, last, *([found] if found is not None else []))
    return rows.select("doc_id", "n", "c", "t1", "t2"), own, out


def components(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of every document."""
    rows, own, linked = classes(docs, num, den)
    known = own.join(linked.select("c", "component_id"), "c", "left").select("c", F.coalesce("component_id", "own").alias("component_id"))
    full = rows.where("n > 0").join(known, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows, all columns, without near duplicates: of each component one row stays.

    It is that with the smallest doc_id, rows without one coming last, then with the smallest hash of its text; of rows
    that are equal in both, one.  So a different text under a doc_id that was seen before stays, and rows with an empty
    set all stay.  Rows travel only where a bit map says that their text may be in a component with others."""
    rows, _, linked = classes(docs, num, den)
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("t1"), F.col("t2")]
    named = rows.where("n > 0").join(linked.select("c", "component"), "c", "left").select(F.coalesce("component", "c").alias("g"), *key)
    each = named.groupBy("g", "none", "id", "t1", "t2").agg(F.count("*").alias("k"))
    whole = F.struct("none", "id", "t1", "t2")
    best = each.groupBy("g").agg(F.min(whole).alias("best"), F.sum("k").alias("all")).where(F.col("all") > 1)
    marks = C.stash(each.join(best, "g").where((whole != F.col("best")) | (F.col("k") > 1)).select("none", "id", "t1", "t2", (whole == F.col("best")).alias("once")))
    shared = docs.sparkSession.sparkContext.broadcast(C.id_bits(marks, "t1", BITS))
    at, text = [C.fresh(docs, x) for x in ("none", "id", "t1", "t2", "hit")], docs.columns.index("text")

    def mark(batches, schema):
        C.release()
        bits = np.frombuffer(shared.value, np.int64)
        for b in C.slices(batches, text):
            t = np.array([name_of((x or "").encode()) for x in b.column(text).to_pylist()], np.int64)
            low = t[:, 0] & (BITS - 1)
            yield C.record_batch([*b.columns, t[:, 0], t[:, 1], bits[low >> 6] >> (low & 63) & 1 == 1], schema)

    kind = docs.schema
    for name, ddl in zip(at[2:], ("long", "long", "boolean")):
        kind = C.with_field(kind, name, ddl)
    marked = C.map_arrow(docs, mark, kind)
    hits = marked.where(F.col(at[4])).withColumns({at[0]: F.col("doc_id").isNull(), at[1]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    once = C.fresh(hits, "once")
    told = hits.join(marks.toDF(*at[:4], once), at[:4], "left")
    alone = told.where(F.col(once)).dropDuplicates(at[:4])
    return marked.where(~F.col(at[4])).select(*docs.columns).unionByName(told.where(F.col(once).isNull()).select(*docs.columns)).unionByName(alone.select(*docs.columns))
