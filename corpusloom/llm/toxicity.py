"""Toxicity by a subsequence string kernel, a support vector machine and Nystroem landmarks.

The kernel of two strings counts common subsequences of three characters that span at most SPAN characters, each
weighted by DECAY for every character skipped, so insults with gaps or inserted characters stay near the plain
ones.  A labelled sentence is a bag of units: its words and its pairs of neighbouring words, in which the blank is a
character that subsequences cross; a pair counts where neither of its words is bad by itself.  A label says of a toxic
document that one of its sentences holds a bad unit, and of a clean one that none does: the units that the model finds
worst in a toxic document are positive, chosen anew in each round, also with a blank inserted; units of clean documents
are negative, and their worst ones are added as hard negatives.  (Whole sentences as units were tried; the README has the
figures: a word drowns in its sentence.)
Landmarks give a feature map K_mm^(-1/2) k_m(x); as the kernel has an explicit (finite) feature space, the trained
machine collapses exactly into one weight for each subsequence, and scoring a unit is a sum of looked-up weights.
A document's score is a logistic function of the values of its two worst units, occurrences counted.

Defined results: null and empty texts score as a text without any word; a table without labels of both kinds gives
score 0 everywhere; no column but the text is an input of a score; each row is scored by itself, so repeated rows and ids
get equal scores, and a null doc_id stays null; a text of any length is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN, DECAY = 6, 0.6
LANDMARKS = 192
SAMPLE_DOCS = 1500  # labelled documents of either label that are learned from, at most
ROUNDS = 4
APART = 5  # one in so many training documents calibrates and isn't learned from
CACHE_WORDS = 300_000
LOW = -3.0  # a missing word's value

_SPACED = re.compile(r"(?:(?<=\s)|^)\w(?:[ .*_-]\w){3,}(?=\W|$)")
_CODE = np.full(0x180, 60, np.int32)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[ord("0") : ord("9") + 1] = 27
_CODE[0xE0:0x100] = np.arange(28, 60)
_CODE[0x100:] = 59
for _a, _b in zip("013457@$", "oieastas"):  # look-alikes
    _CODE[ord(_a)] = _CODE[ord(_b)]
_CODE[ord(" ")] = 63
_STEPS = [(d1, d2, DECAY ** (d2 - 2)) for d2 in range(2, SPAN) for d1 in range(1, d2)]
SIZE = 64**3
_MARKS = ".,;:!?\"'()[]{}|#*%&$<>-_«»¿¡"
PHRASES = 2000  # pairs that training looks at because they are more frequent in toxic documents, at most
SAMPLE_PAIRS = 30  # other pairs of a clean document that training looks at
FIRST_NEGATIVES = 2000  # units of clean documents that the first machine is trained against, drawn at random
NEGATIVES = 12_000  # of the hard negatives gathered in later rounds, the machine takes the worst two thirds of this
# number and an even draw of the others; it bounds the driver's memory (a row of LANDMARKS doubles each) and time
CHUNK_WORDS = 30_000


def spans_of(word: str) -> list[str]:
    """A token as the words that are scored: without marks at its ends; very long tokens as overlapping stretches."""
    w = word.strip(_MARKS) or word
    return [w] if len(w) <= 24 else [w[k : k + 16] for k in range(0, len(w) - 8, 8)]


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+", text) if s.strip()]


def neighbours(text: str | None) -> tuple[list[str], bytearray]:
    """The words of all sentences in order, and whether (1) the next one is of the same sentence or not (0)."""
    words: list[str] = []
    follows = bytearray()
    for s in sentences((text or "").lower()):
        found = s.split()
        words += found
        follows += b"\1" * (len(found) - 1) + b"\0"
    return words, follows


def bare(word: str) -> str:
    return word.strip(_MARKS) or word


def pairs_of(text: str | None) -> set[str]:
    words, follows = neighbours(text)
    words = [bare(w) for w in words]
    return {f"{a} {b}" for a, b, f in zip(words, words[1:], follows) if f and len(a) + len(b) < 32}


def _inner(c: np.ndarray, table: np.ndarray, d2: int) -> np.ndarray:
    """Weights of the subsequences that begin at each place and span d2 + 1 characters, as running sums."""
    m = len(c) - d2
    outer = (c[:m] << 12) | c[d2:]
    inner = table[outer | (c[1 : 1 + m] << 6)]
    for d1 in range(2, d2):
        inner += table[outer | (c[d1 : d1 + m] << 6)]
    out = np.zeros(m + 1)
    np.cumsum(inner, dtype=np.float64, out=out[1:])
    return out


def pair_values(words: list[str], table: np.ndarray) -> np.ndarray:
    """apply_weights for every word joined with the next by a blank: differences of one array's running sums, the marks
    at the pair's ends apart; pairs shorter than SPAN one by one."""
    c = _codes([" ".join(words)])[0][1:-1]
    mid = c << 6
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(sizes + 1) - 1
    s, e = (end - sizes)[:-1], end[1:]
    out = np.zeros(len(s))
    short = np.flatnonzero(e - s < SPAN).tolist()
    if short:
        texts = [f"{words[k]} {words[k + 1]}" for k in short]
        index = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        out[short] = apply_weights(list(index), table)[[index[t] for t in texts]]
    long = np.flatnonzero(e - s >= SPAN)
    s, e = s[long], e[long]
    value, square = np.zeros(len(s)), np.zeros(len(s))
    first, last = table[61 << 12 : 62 << 12], table[62::64]
    for d2 in range(2, SPAN) if len(s) else ():
        w, ends = DECAY ** (d2 - 2), np.zeros(len(s))
        for d1 in range(1, d2):
            ends += first[mid[s - 1 + d1] | c[s - 1 + d2]] + last[mid[e - d2] | c[e - d2 + d1]]
        sums = _inner(c, table, d2)
        value += w * (sums[e - d2] - sums[s] + ends)
        square += w * w * (d2 - 1) * (e - s + 2 - d2)
    out[long] = value / np.sqrt(np.maximum(square, 1e-12))
    return out


def tokens_of(text: str | None) -> set[str]:
    if not text:
        return set()
    low = text.lower()
    out = set(low.split())
    for m in _SPACED.finditer(low):  # spelt-out words
        out.add(re.sub(r"[ .*_-]", "", m[0]))
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words with a mark at either end, and each code's word."""
    joined = "".join(f"\x01{w}\x02" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    c = np.where(points < 0x180, _CODE[np.minimum(points, 0x17F)], 59)
    c[points == 1], c[points == 2] = 61, 62
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return c.astype(np.int32), np.repeat(np.arange(len(words)), lengths)


def _occurrences(words: list[str]):
    """(word, subsequence, weight) of every counted subsequence, a step of distances at a time."""
    c, owner = _codes(words)
    for d1, d2, w in _STEPS:
        if len(c) <= d2:
            continue
        same = np.flatnonzero(owner[:-d2] == owner[d2:])
        yield owner[same], (c[same] << 12) | (c[same + d1] << 6) | c[same + d2], w


def norms(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words))
    for who, _, w in _occurrences(words):
        out += w * w * np.bincount(who, minlength=len(words))
    return np.sqrt(np.maximum(out, 1e-12))


def apply_weights(words: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of the subsequences' weights over the norm, for each word, by running sums over all words in a row."""
    c, _ = _codes(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2  # with a mark at either end
    end = np.cumsum(sizes)
    value, square = np.zeros(len(words)), np.zeros(len(words))
    for d2 in range(2, SPAN):
        if len(c) <= d2:
            break
        w, sums, own = DECAY ** (d2 - 2), _inner(c, table, d2), np.flatnonzero(sizes > d2)
        value[own] += w * (sums[end[own] - d2] - sums[end[own] - sizes[own]])
        square[own] += w * w * (d2 - 1) * (sizes[own] - d2)
    return value / np.sqrt(np.maximum(square, 1e-12))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    lm = norms(landmarks)
    out = np.empty((len(words), len(landmarks)))
    for k, landmark in enumerate(landmarks):  # one landmark's subsequences at a time
        table = np.zeros(SIZE)
        for _, u, w in _occurrences([landmark]):
            np.add.at(table, u, w)
        out[:, k] = apply_weights(words, table) / lm[k]
    return out


def _hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last weight is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    reg = np.r_[np.full(z.shape[1], ridge), 1e-3]
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        on = margin > 0
        g = reg * w - 2 * x[on].T @ (cost[on] * y[on] * margin[on])
        h = np.diag(reg) + 2 * (x[on].T * cost[on]) @ x[on]
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _machine(positive: list[str], negative: list[str], rng) -> np.ndarray:
    """Weights of the subsequences, the bias last."""
    half = LANDMARKS // 2
    take = lambda words, n: list(np.array(words, dtype=object)[np.sort(rng.permutation(len(words))[:n])])
    landmarks = list(dict.fromkeys(take(sorted(set(positive)), half) + take(sorted(set(negative)), half)))
    kmm = kernel(landmarks, landmarks)
    vals, vecs = np.linalg.eigh((kmm + kmm.T) / 2)
    good = vals > 1e-6
    root = vecs[:, good] / np.sqrt(vals[good])
    counted = Counter(positive)
    words = [*counted, *dict.fromkeys(negative)]
    y = np.r_[np.ones(len(counted)), -np.ones(len(words) - len(counted))]
    n_pos, n_neg = len(counted), len(words) - len(counted)
    cost = np.where(y > 0, 20.0 / n_pos * max(1, n_neg) ** 0.5, 20.0 / max(1, n_neg) * max(1, n_neg) ** 0.5)
    w = _hinge(kernel(words, landmarks) @ root, y, cost, ridge=0.3)
    alpha = root @ w[:-1] / norms(landmarks)
    table = np.zeros(SIZE + 1)
    for who, u, d in _occurrences(landmarks):
        np.add.at(table, u, d * alpha[who])
    table[-1] = w[-1]
    return table


GRAM_BUCKETS = 1 << 22


def _first_scores(words: list[str], docs: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Before any machine: a word's standing is that of its most telling stretch of four to six characters, the
    word's ends counted as characters.  Stretches are counted by a hash into a table of fixed size."""
    n1 = sum(y for y, _ in docs)
    n0 = len(docs) - n1
    c, owner = _codes(words)
    owner = owner.astype(np.int32)
    found = []  # of each length: the stretches' buckets, word after word, and where each word's begin
    for n in (4, 5, 6):
        if len(c) >= n:
            h = np.zeros(len(c) - n + 1, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - n + 1 + k].astype(np.uint64)
                h ^= h >> np.uint64(32)
            h %= np.uint64(GRAM_BUCKETS)
            same = owner[: len(c) - n + 1] == owner[n - 1 :]
            found.append((h.astype(np.int32)[same], np.searchsorted(owner[: len(c) - n + 1][same], np.arange(len(words) + 1))))
            del h, same
    seen = np.zeros((2, GRAM_BUCKETS), np.int32)
    for y, ids in docs:
        if len(ids):
            seen[y][np.unique(np.concatenate([bucket[at[k] : at[k + 1]] for bucket, at in found for k in np.unique(ids).tolist()]))] += 1
    told = np.flatnonzero(seen[1] > 1)
    p1, p0 = seen[1][told] / n1, seen[0][told] / n0
    p = (seen[0][told] + seen[1][told]) / (n1 + n0)
    z = np.zeros(GRAM_BUCKETS)
    z[told] = (p1 - 3 * p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    del seen
    out = np.zeros(len(words))
    for bucket, at in found:
        np.maximum.at(out, np.repeat(np.arange(len(words), dtype=np.int32), np.diff(at)), z[bucket])
    return out


def train(texts, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray] | None:
    """Subsequence weights and the logistic calibration from (label, units of the sentences).

    The machine is trained on four fifths of the documents and calibrated on the others, which it has not seen: its
    values of documents that it learned from would put the threshold too low."""
    index: dict[str, int] = {}
    docs = [(y, np.array([index.setdefault(w, len(index)) for w in ws], np.int64)) for y, ws in texts]
    if len({y for y, _ in docs}) < 2 or not index:
        return None
    seen, apart = [d for k, d in enumerate(docs) if k % APART < APART - 1], docs[APART - 1 :: APART]
    if min(len({y for y, _ in x}) for x in (seen, apart)) < 2:  # too few to part
        seen = apart = docs
    words = list(index)
    pairs = np.array([k for k, w in enumerate(words) if " " in w], np.int64)
    parts = np.array([[index.get(x, -1) for x in words[k].split(" ", 1)] for k in pairs], np.int64).reshape(-1, 2)
    del index
    rng = np.random.default_rng(11)
    value = _first_scores(words, seen)
    value[pairs[_part_values(value, parts) >= value[pairs]]] = 0
    clean = np.concatenate([ids for y, ids in seen if not y])
    negative = clean[rng.permutation(len(clean))[:FIRST_NEGATIVES]].tolist()
    table = None
    for turn in range(rounds):
        positive: list[int] = []
        for y, ids in seen:
            if not len(ids):
                continue
            top = ids[np.lexsort((ids, -value[ids]))[:3]].tolist()
            if y:
                positive += [top[0], *(k for k in top[1:] if value[k] > (4 if turn == 0 else 0) and value[k] >= 0.5 * value[top[0]])]
            else:
                negative += top[:2]
        negative = list(dict.fromkeys(negative))
        if len(negative) > NEGATIVES:
            ranked = sorted(negative, key=lambda k: (-value[k], k))
            worst = 2 * NEGATIVES // 3
            negative = ranked[:worst] + ranked[worst :: max(1, 3 * len(ranked) // NEGATIVES)]
        known = set(negative)
        positive = [k for k in positive if k not in known] or positive
        bad = [words[k] for k in positive]
        split = [f"{w[:k]} {w[k:]}" for w in bad if " " not in w for k in range(1, len(w))]  # a blank may be inserted
        split = [split[k] for k in np.sort(rng.permutation(len(split))[: 2 * len(bad)])]
        table = _machine(bad + split, [words[k] for k in negative], rng)
        value = np.concatenate([apply_weights(words[k : k + 20_000], table[:-1]) for k in range(0, len(words), 20_000)]) + table[-1]
        if turn < rounds - 1:  # a pair that is no worse than one of its words tells nothing new
            value[pairs[_part_values(value, parts) >= value[pairs]]] = LOW
    value[pairs[(value[pairs] <= 0) | (_part_values(value, parts) > 0)]] = LOW  # as in scoring
    x = np.array([[1.0, *_worst(value[ids].tolist())] for _, ids in apart])
    y = np.array([float(y) for y, _ in apart])
    w = np.zeros(3)
    weight = np.where(y > 0, 0.3 / y.mean(), 0.7 / (1 - y.mean())) / len(y)  # clean texts count more
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-3 * w
        h = (x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(3)
        w -= np.linalg.solve(h, g)
    return table, w


def _part_values(value: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The larger value of a pair's two words; LOW for words that stand nowhere alone."""
    return np.where(parts >= 0, value[parts], LOW).max(1) if len(parts) else np.zeros(0)


def _worst(values: list[float]) -> tuple[float, float]:
    """The two largest values, between LOW and 3."""
    if not values:
        return LOW, LOW
    first = max(values)
    values.remove(first)
    second = max(values, default=LOW)
    return min(3.0, max(LOW, first)), min(3.0, max(LOW, second))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = SAMPLE_DOCS, where=None):
    """Train on at most per_class labelled documents of either label; where picks the labels that may be learned from."""

    def listed(parts):
        for _, texts in parts:
            for line in texts:
                y, found = int(line[0]), sorted(pairs_of(line[1:]))
                for at in range(0, len(found), 4096):
                    yield [y] * len(found[at : at + 4096]), found[at : at + 4096]

    def run(parts):
        for _, texts in parts:
            for line in texts:
                y, t = int(line[0]), line[1:]
                # a document's value has its two worst units, so a third occurrence tells nothing
                found = Counter(w for s in sentences(t) for x in tokens_of(s) for w in spans_of(x))
                pairs = pairs_of(t)
                own = zlib.crc32(t.encode("utf-8", "replace"))  # each document draws others
                some = [] if y else sorted(pairs, key=lambda w: (zlib.crc32(w.encode("utf-8", "replace"), own), w))[:SAMPLE_PAIRS]
                units = [w for w in sorted(found) for _ in range(min(2, found[w]))] + sorted((pairs & phrases).union(some))
                yield [(y, "\n".join(units))]

    rows = C.labelled_sample(docs, labels, column, per_class, where)
    sample = C.stash(rows.select(F.col("doc_id"), F.concat(F.col("y").cast("string"), F.coalesce("text", F.lit(""))).alias("text")))
    n = {int(r["y"]): r["n"] for r in sample.groupBy(F.substring("text", 1, 1).alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        C.forget(sample)
        return None
    counts = C.map_texts(sample, listed, "y int, pair string").groupBy("pair").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    ahead = F.col("n1") / n[1] - 3 * F.col("n0") / n[0]
    phrases = {r["pair"] for r in counts.where((F.col("n1") > 1) & (ahead > 0)).orderBy(ahead.desc(), "pair").limit(PHRASES).collect()}
    rows = sorted((r["y"], r["words"]) for r in C.map_texts(sample, run, "y int, words string").collect())
    C.forget(sample)

    def taken():
        while rows:  # a document's text of units goes as it is read
            y, ws = rows.pop()
            yield y, ws.split("\n") if ws else []

    rows.reverse()
    return train(taken())


class _Bare(dict):
    """bare() of words, remembered; it starts anew when it is full."""

    def __init__(self, most: int):
        self.most = most

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = bare(word)
        return out


class Scorer:
    """Word values of one worker, in a bounded cache, and documents' scores."""

    def __init__(self, model, most: int = CACHE_WORDS):
        table, self.logit = model
        self.table, self.bias = table[:-1].astype(np.float32), float(table[-1])  # half the bytes to look up in
        self.cache: dict[str, float] = {}
        self.bare = _Bare(most)
        self.most = most

    def learn(self, tokens: set[str]) -> None:
        new = list(tokens - self.cache.keys())
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
            new = list(tokens)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            words = list(map(self.bare.__getitem__, part))
            values = (apply_weights(words, self.table) + self.bias).tolist()
            self.cache.update(zip(part, values))
            for t, w in zip(part, words):
                if len(w) > 24:  # a long one counts by its worst stretch
                    self.cache[t] = float(apply_weights(spans_of(t), self.table).max()) + self.bias

    def pairs(self, texts) -> list[list[float]]:
        """The values above 0 of each text's pairs whose words are not bad by themselves."""
        out: list[list[float]] = [[] for _ in texts]
        words, follows, upto, first = [], bytearray(), [], 0
        for k, t in enumerate(texts):
            w, f = neighbours(t)
            words += w
            follows += f
            upto.append(len(words))
            if len(words) > 1 and (len(words) >= CHUNK_WORDS or k == len(texts) - 1):
                values = pair_values(list(map(self.bare.__getitem__, words)), self.table) + self.bias
                hit = np.flatnonzero((values > 0) & (np.frombuffer(follows, np.uint8)[:-1] > 0))
                for j, at in zip(hit.tolist(), (first + np.searchsorted(upto, hit, "right")).tolist()):
                    if self.cache.get(words[j], LOW) <= 0 and self.cache.get(words[j + 1], LOW) <= 0:
                        out[at].append(float(values[j]))
                words, follows, upto, first = [], bytearray(), [], k + 1
        return out

    def score(self, text: str | None, found: set[str], pairs=()) -> float:
        a, b = _worst([*map(self.cache.__getitem__, found), *pairs])
        if a > 0:  # a bad word twice is two
            split = text.lower().split()
            a, b = _worst([*(self.cache[t] for t in [*split, *(found - set(split))]), *pairs])
        return float(1 / (1 + np.exp(-np.clip(self.logit @ (1.0, a, b), -30, 30))))


def _scored(spark, model):
    """A function from a list of texts to their scores, for workers."""
    shared = spark.sparkContext.broadcast(model)
    name = zlib.crc32(model[0].tobytes() + model[1].tobytes())

    def of(texts: list) -> list[float]:
        scorer = C.held_by_worker(("toxicity", name), lambda: Scorer(shared.value))
        found = [tokens_of(t) for t in texts]
        scorer.learn(set().union(*found))
        return list(map(scorer.score, texts, found, scorer.pairs(texts)))

    return of


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every document."""
    if model is None:
        return C.docs_of(docs).select("doc_id", F.lit(0.0).alias("score"))
    of = _scored(docs.sparkSession, model)

    def run(parts):
        for ids, texts in parts:
            yield ids, of(texts)

    return C.map_texts(docs, run, "doc_id long, score double")


def below(docs: DataFrame, model, threshold: float, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text's score stays under the threshold."""
    if model is None:
        return docs.where(F.lit(0.0) < threshold)
    of, at = _scored(docs.sparkSession, model), docs.columns.index(text)

    def run(batches, _):
        for b in C.slices(batches, at):
            yield b.filter(pa.array([x < threshold for x in of(b.column(at).to_pylist())]))

    return C.map_arrow(docs, run, docs.schema)
