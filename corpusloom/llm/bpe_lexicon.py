"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

The corpus's most frequent chunks (a run of non-blanks with the blank before it, or a run of white space) are
compiled with their token ids into an automaton that shares prefixes and suffixes.  A path's edge weights add up
to the chunk's number, which leads to its ids in one flat table.  The bytes of the automaton are written to a
file and memory-mapped once per Python worker.  Chunks that it doesn't hold are split by the tokenizer's pattern
and merged exactly, lowest rank first; both kinds go through a bounded cache.

Defined results: null and empty texts have no tokens and decode to the empty text; a special token's string in
a text becomes that token's id, as the tokenizers library does.  Lone surrogates can't occur in a Spark string.  Each
row is encoded by itself, so repeated rows and ids get equal rows, and a null doc_id stays null; chunks that are as
frequent as the first one left out stay out too; columns besides id and text don't matter; texts of any length are
encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from array import array
from collections import Counter

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The byte-level pre-tokenizer's public pattern and the Unicode white space it knows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PIECE = regex.compile(PATTERN.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}"))

LEXICON_WORDS = 1 << 16
LONGEST = 64  # characters of a chunk in the lexicon; longer ones are merged as unseen words are
FLUSH_CHUNKS = 600_000
CACHE_WORDS = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """The vocabulary file's merges over ids, applied lowest rank first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.first, self.last = [0] * 256, [0] * 256  # of a byte within a word and at its end
        for c, b in alphabet.items():
            self.first[b], self.last[b] = vocab[c], vocab[c + suffix]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]):
            self.rank.setdefault(vocab[a] * self.size + vocab[b], k)
            self.made.append(vocab[(a.removesuffix(suffix) if suffix else a) + b])
        none: dict[int, int] = {}
        self.after: list[dict[int, int]] = [none] * self.size  # of each id, the rank of its merge with the id that follows
        for key, k in self.rank.items():
            a, b = divmod(key, self.size)
            if self.after[a] is none:
                self.after[a] = {}
            self.after[a][b] = k
        self.token = [b""] * self.size
        self.decimal = list(map(str, range(self.size)))
        for s, i in vocab.items():
            self.token[i] = bytes(alphabet[c] for c in (s.removesuffix(suffix) if suffix else s))
        for s, i in self.special.items():
            self.token[i] = s.encode()

    def merge(self, word: bytes) -> list[int]:
        ids = [self.first[b] for b in word]
        if word:
            ids[-1] = self.last[word[-1]]
        if len(ids) > 48:
            return self._merge_long(ids)
        after, none, made = self.after, len(self.made), self.made
        ranks = [after[a].get(b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at] = new = made[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = after[ids[at - 1]].get(new, none)
            if at < len(ranks):
                ranks[at] = after[new].get(ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for long runs."""
        n, rank, size = len(ids), self.rank, self.size
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[key], k, ids[k], ids[k + 1]) for k in range(n - 1) if (key := ids[k] * size + ids[k + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[r], -1
            right[k] = right[j]
            if right[k] >= 0:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (p := rank.get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (p, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def pieces(self, chunk: str) -> list[int]:
        return [i for p in PIECE.findall(chunk) for i in self.merge(p.encode())]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer over sorted words, as bytes.

    States with the same right language are one state; each edge carries how many words come before it among
    its state's words, so that the sum along a path is the word's place in sorted order."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    counts: list[int] = []

    def close(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(final + sum(counts[t] for _, t in edges))
        return register[key]

    path: list[list] = [[False, []]]  # the open states of the word before: final, closed edges
    before = b""
    for w in words:
        same = len(os.path.commonprefix([w, before]))
        for k in range(len(before), same, -1):
            final, edges = path.pop()
            path[-1][1].append((before[k - 1], close(final, edges)))
        path += [[False, []] for _ in range(len(w) - same)]
        path[-1][0] = True
        before = w
    for k in range(len(before), 0, -1):
        final, edges = path.pop()
        path[-1][1].append((before[k - 1], close(final, edges)))
    root = close(*path[0])

    first, label, target, weight = array("I"), bytearray(), array("I"), array("I")
    for final, edges in states:
        first.append(len(label))
        below = int(final)
        for c, t in edges:
            label.append(c)
            target.append(t)
            weight.append(below)
            below += counts[t]
    first.append(len(label))
    finals = bytes(int(f) for f, _ in states)
    offset, ids = array("I", [0]), array("I")
    for w in words:
        ids.extend(entries[w])
        offset.append(len(ids))
    head = array("I", [root, len(states), len(label), len(words), len(ids)])
    pad = lambda b: bytes(b) + b"\0" * (-len(b) % 4)
    return b"".join([head.tobytes(), first.tobytes(), target.tobytes(), weight.tobytes(), offset.tobytes(), ids.tobytes(), pad(finals), pad(label)])


class Lexicon:
    """The compiled automaton, read through a memory map."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:  # the map outlives the name; nothing is left behind
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        whole = memoryview(self.map)
        head = whole[:20].cast("I")
        self.root, n, e, w, i = head
        at = 20
        for name, count in (("first", n + 1), ("target", e), ("weight", e), ("offset", w + 1)):
            setattr(self, name, whole[at : at + 4 * count].cast("I"))
            at += 4 * count
        self.ids = whole[at : at + 4 * i]
        at += 4 * i
        self.final = whole[at : at + n]
        self.label = at + n + (-n % 4)

    def beginnings(self, n: int = 6) -> set[bytes]:
        """The words' first n bytes, shorter words as they are; most unseen words are told by them."""
        out, todo = set(), [(self.root, b"")]
        while todo:
            state, word = todo.pop()
            if len(word) == n:
                out.add(word)
                continue
            if self.final[state]:
                out.add(word)
            for edge in range(self.first[state], self.first[state + 1]):
                todo.append((self.target[edge], word + self.map[self.label + edge : self.label + edge + 1]))
        return out

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian unsigned 32-bit bytes, or None."""
        state, number = self.root, 0
        first, start, find, target, weight = self.first, self.label, self.map.find, self.target, self.weight
        for k in range(len(word)):
            edge = find(word[k : k + 1], start + first[state], start + first[state + 1]) - start
            if edge < 0:
                return None
            number += weight[edge]
            state = target[edge]
        if not self.final[state]:
            return None
        return bytes(self.ids[4 * self.offset[number] : 4 * self.offset[number + 1]])


def _latin_word(word: str) -> bool:
    """Letters of Latin-1 alone: the tokenizer's pattern leaves such a word whole and parts it from marks."""
    if word.isascii():
        return word.isalpha()
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return word.isalpha()


class _Cache(dict):
    """chunk to id bytes; when it is full, what is in it grows old and goes when it is full again, but for what is met
    meanwhile."""

    def __init__(self, lexicon: Lexicon, merges: Merges, most: int):
        self.lexicon, self.merges, self.most = lexicon, merges, most
        self.beginnings = lexicon.beginnings()
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.old.get(chunk)) is not None:
            pass
        elif chunk[-1] in ".,!" and _latin_word(chunk[:-1].lstrip(" ")):
            out = self[chunk[:-1]] + self[chunk[-1]]
        else:
            raw = chunk.encode()
            out = self.lexicon.find(raw) if raw[:6] in self.beginnings else None
            if out is None:
                out = array("I", self.merges.merge(raw) if _latin_word(chunk.lstrip(" ")) else self.merges.pieces(chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out


class Codec:
    """encode() and decode() of one worker."""

    def __init__(self, path: str, blob: bytes, cache: int = CACHE_WORDS):
        self.merges = Merges(path)
        self.cache = _Cache(Lexicon(blob), self.merges, cache)
        names = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, CHUNK.findall(text)))

    def encode(self, text: str | None) -> array:
        out = array("I")
        if not text:
            return out
        if self.special is None or not self.special.search(text):
            out.frombytes(self._plain(text))
            return out
        for part in self.special.split(text):
            if part in self.merges.special:
                out.append(self.merges.special[part])
            else:
                out.frombytes(self._plain(part))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.merges.token.__getitem__, ids)).decode("utf-8", "replace")


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(chunk, n): how often each chunk of at most LONGEST characters occurs in all documents."""

    def count(parts):
        seen: Counter = Counter()

        def packed():
            rows = {w: n for w, n in seen.items() if len(w) <= LONGEST}
            return list(rows), list(rows.values())

        for _, texts in parts:
            for t in texts:
                if t:
                    seen.update(CHUNK.findall(t))
            if len(seen) >= FLUSH_CHUNKS:
                yield packed()
                seen.clear()
        yield packed()

    return C.map_texts(docs, count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def frequent_chunks(docs: DataFrame, words: int) -> DataFrame:
    """(chunk, n): the most frequent chunks, no more than words of them."""
    return C.most_frequent(C.stash(chunk_counts(docs)), words)


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """Compiled bytes for the most frequent chunks; their number, and so what is broadcast, is bounded by words."""
    merges = Merges(path)
    found = frequent_chunks(docs, words)
    rows = [r["chunk"] for r in found.select("chunk").collect()]
    C.forget(found)
    return compile_lexicon({w.encode(): merges.pieces(w) for w in rows})


def codec_for(path: str, blob: bytes, name: str) -> Codec:
    """One codec per worker and lexicon."""
    return C.held_by_worker(("codec", name), lambda: Codec(path, blob))


def encode(docs: DataFrame, path: str, words: int = LEXICON_WORDS, fold=None, fields: str = "ids array<int>") -> DataFrame:
    """doc_id and what fold(codec, text) gives; by default the token ids."""
    blob = build_lexicon(docs, path, words)
    name, shared = hashlib.sha256(blob + path.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(blob)
    fold = fold or (lambda codec, text: (list(codec.encode(text)),))

    def run(parts):
        codec = codec_for(path, shared.value, name)
        for ids, texts in parts:
            yield [(i, *fold(codec, t)) for i, t in zip(ids, texts)]

    return C.map_texts(docs, run, f"doc_id long, {fields}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches, schema):
        codec = codec_for(path, compile_lexicon({}), path)
        for b in batches:
            for at in range(0, b.num_rows, C.SLICE_ROWS):
                x = b.slice(at, C.SLICE_ROWS)
                yield C.record_batch([x.column(0), [codec.decode(ids if ids is not None else []) for ids in x.column(1).to_pylist()]], schema)

    return C.map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def digests(codec: Codec, text: str | None) -> tuple[int, str, str]:
    """Token count, hash of the ids and hash of the text decoded from them."""
    ids = codec.encode(text).tolist()
    listed = ",".join(map(codec.merges.decimal.__getitem__, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def round_trip(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    return encode(docs, path, words, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
