"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Documents longer than a sequence are cut into full pieces; only their last piece meets the others.  Pieces are
dealt by a hash into shards of bounded size, so no task grows with the corpus.  In a shard each bin is filled
greedily, largest fitting piece first; then its smallest piece is replaced by two unpacked pieces if these fill
the widened gap more tightly.  A shard leaves at most one badly filled bin.

Defined results: a null or empty text is one piece that holds the end token alone; repeated rows are packed
each on its own, also where they share a doc_id or have none; pieces of equal length are taken by doc_id, then number; an
empty table gives an empty one; columns besides id and text don't matter; a text of any length is cut whole.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .bpe_lexicon import Merges

CAPACITY = 4096
SHARD_ROWS = 20_000
CACHE_WORDS = 500_000

def _below(text: str) -> bool:
    """Whether all characters are below U+0130, the first whose lower case is longer; Latin-1 tells most texts quickly."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < "İ"
    return True


class _Cache(dict):
    """Blank-free chunk to the bytes of its ids; words are independent, as this tokenizer drops white space.

    Lower-case Latin words, with a full stop or comma after them, are merged here; all else goes to the library.  When
    it is full, what is in it grows old and goes when it is full again, but for what is met meanwhile."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Merges(path)
        self.old: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]

    def __missing__(self, word: str) -> bytes:
        if (out := self.old.get(word)) is not None:
            pass
        elif word[-1] in ".," and word[:-1].isalpha() and word[-2] < "İ":
            out = self[word[:-1]] + self[word[-1]]
        elif word.isalpha() and max(word) < "İ" and word.islower():
            out = array("I", self.merges.merge(word.encode())).tobytes()
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        plain = _below(text)
        if any(x in text for x in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f\x85"):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, (text.lower() if plain else text).split()))


def tokenizer_for(path: str) -> _Cache:
    return C.held_by_worker(("packing", path), lambda: _Cache(path, CACHE_WORDS))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with end_id after them, and the piece's number in
    its task, by which copies are told apart."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(parts):
        cache, made = tokenizer_for(path), 0
        for ids, texts in parts:
            rows = []
            for i, t in zip(ids, texts):
                found = cache.encode(t) + end
                for k, at in enumerate(range(0, len(found), 4 * capacity)):
                    part = found[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), made))
                    made += 1
            yield rows

    return C.map_texts(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long, made long")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.  Lengths are counted, so a bin costs steps over distinct lengths, not pieces."""
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    last = np.cumsum(counts)  # pieces of length x lie in order[last[x] - counts[x] : last[x]]; taken from the end
    upto = np.where(counts > 0, np.arange(capacity + 1), 0)
    upto = np.maximum.accumulate(upto)  # largest length at hand that is at most x; kept true by take()
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)

    def take(x: int) -> int:
        counts[x] -= 1
        last[x] -= 1
        if not counts[x]:
            end = x + 1
            while end <= capacity and upto[end] == x:
                end += 1
            upto[x:end] = upto[x - 1]
        return order[last[x]]

    def give_back(x: int) -> None:
        if not counts[x]:
            end = x
            while end <= capacity and upto[end] < x:
                end += 1
            upto[x:end] = x
        counts[x] += 1
        last[x] += 1

    left, number = n, 0
    while left:
        gap, held = capacity, []
        while (x := int(upto[gap])) > 0:
            held.append((x, take(x)))
            gap -= x
        if gap and len(held) > 1:
            small, _ = held[-1]  # greedy takes the largest first, so the last one is the smallest
            room = gap + small
            firsts = np.arange(1, room // 2 + 1)
            firsts = firsts[counts[1 : room // 2 + 1] > 0]
            if len(firsts):
                seconds = upto[room - firsts]
                total = firsts + np.where((seconds > firsts) | ((seconds == firsts) & (counts[firsts] > 1)), seconds, 0)
                k = int(np.argmax(total))
                if total[k] > small and total[k] > firsts[k]:
                    a, b = int(firsts[k]), int(total[k] - firsts[k])
                    _, p = held.pop()
                    give_back(small)
                    order[last[small] - 1] = p
                    held += [(b, take(b)), (a, take(a))]
        at = 0
        for x, p in held:
            where[p], offset[p] = number, at
            at += x
        left -= len(held)
        number += 1
    return where, offset


def shards_for(rows: int, shard_rows: int = SHARD_ROWS) -> int:
    return max(1, math.ceil(rows / shard_rows))


def pack(sized: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """The rows with sequence_id and offset; needs doc_id, piece and length of at most capacity.

    Full pieces are sequences of their own and meet no other row.  A sequence's number is its shard's number in
    the high bits and the bin's in the low ones.  All columns deal the rows into shards."""
    columns = [c for c in sized.columns if c not in ("sequence_id", "offset")]
    shard = C.fresh(sized, "shard")
    fields = T.StructType([*(sized.schema[c] for c in columns), T.StructField("sequence_id", C.LONG), T.StructField("offset", C.LONG)])

    def one(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("length", "doc_id", "piece")])
        rows = rows.take(order)
        where, offset = best_two_fit(rows["length"].to_numpy(), capacity)
        first = rows[shard][0].as_py() << 32
        return rows.drop_columns([shard]).append_column("sequence_id", pa.array(first + where, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = sized.select(*columns, F.pmod(F.xxhash64(*[sized[c] for c in columns]), F.lit(shards)).alias(shard))
    return dealt.groupBy(shard).applyInArrow(one, fields)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Cut, size and pack whole documents: a row per piece with its sequence and place."""
    sized = C.stash(pieces(docs, path, capacity, end_id))
    return pack(sized, shards_for(sized.count(), shard_rows), capacity).drop("made")
