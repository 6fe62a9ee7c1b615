"""Document quality by labelling lines: a linear-chain conditional random field and its Viterbi path.

Each line of a text is content or boilerplate.  The field has two states, a linear score of line features for each
and a score for each transition.  It is trained here, on a bounded sample of labelled documents, by maximum
likelihood; lines of good documents are content, lines of poor ones start as boilerplate and are labelled anew by
their own scores between the passes, since a poor document may hold good lines; transitions are learned after the
first pass.  A document is kept when its base rules
hold and the share of its words that lies on content lines reaches KEEP_SHARE.

Defined results: null and empty texts have no words, fail the base rules and are not kept; a table without labels
of both kinds gives a neutral model, under which the base rules alone decide; each row is rated by itself, so repeated
rows and ids get equal rows, and a null doc_id stays null; columns besides id and text don't matter; a text of any
length is read whole.
"""

from __future__ import annotations

from collections import Counter
from operator import ne

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KEEP_SHARE = 0.65
SAMPLE_DOCS = 1500  # labelled documents of either kind that the field is trained on, at most
SYMBOLS = "#*$%&|<>"
STATES = 2  # 0 content, 1 boilerplate

FEATURES = ("bias", "short", "words", "symbols", "pipes", "marks", "digits", "upper", "first_upper", "repeats", "same_line", "word_length", "ends", "stops", "braces", "distinct")


def base(text: str | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of a whole text."""
    text = text or ""
    words = text.encode().split()  # bytes split at exactly the blank and tab to carriage return
    n = len(words)
    chars = len(text) - sum(map(text.count, C.SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(C.SPACE)]
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < n - 2:
            covered = bytearray(n)
            for k, w in enumerate(windows):
                if seen[w] > 1:
                    covered[k] = covered[k + 1] = covered[k + 2] = 1
            repeat = sum(covered)
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, words


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def line_features(lines: list[str]) -> np.ndarray:
    """A row of FEATURES for each line, all between 0 and about 1."""
    out = np.zeros((len(lines), len(FEATURES)))
    seen: set[str] = set()
    for k, s in enumerate(lines):
        words = s.split()
        n, m = max(1, len(words)), max(1, len(s))
        distinct = len(set(words))
        row = out[k]
        row[0] = 1
        row[1] = len(words) < 5
        row[2] = min(1.0, len(words) / 60)
        row[3] = min(1.0, 8 * sum(map(s.count, SYMBOLS)) / m)
        row[4] = min(1.0, s.count(" | ") / n * 4)
        row[5] = min(1.0, 4 * (s.count("!") + s.count("?")) / n)
        row[6] = min(1.0, 4 * sum(map(s.count, "0123456789")) / m)
        low = s.lower()
        row[7] = min(1.0, 2 * sum(map(ne, s, low if len(low) == len(s) else map(str.lower, s))) / m)
        row[8] = sum(w[0].isupper() for w in words) / n
        row[9] = sum(a == b for a, b in zip(words, words[1:])) / n
        row[10] = s in seen
        row[11] = min(1.0, (m - n) / n / 12)
        row[12] = s.rstrip()[-1:] in ".!?:"
        row[13] = sum(len(w) <= 3 for w in words) / n
        row[14] = min(1.0, 8 * sum(map(s.count, "{}=;/\\_")) / m)
        row[15] = 1 - distinct / n
        seen.add(s)
    return out


def viterbi(x: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best state sequence; ties go to content."""
    scores = x @ emit
    n = len(scores)
    back = np.zeros((n, STATES), np.int8)
    at = scores[0]
    for k in range(1, n):
        a, b = at
        to0, to1 = (a + move[0, 0], b + move[1, 0]), (a + move[0, 1], b + move[1, 1])
        back[k] = to0[1] > to0[0], to1[1] > to1[0]
        at = np.array((max(to0), max(to1))) + scores[k]
    path = np.zeros(n, np.int8)
    path[-1] = at[1] > at[0]
    for k in range(n - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def _gradient(seqs, emit, move):
    """Gradient of the log likelihood: observed less expected counts, by forward and backward sums."""
    ge, gm, total = np.zeros_like(emit), np.zeros_like(move), 0
    for x, y in seqs:
        s = x @ emit
        n = len(s)
        f, b = np.zeros((n, STATES)), np.zeros((n, STATES))
        f[0] = s[0]
        for k in range(1, n):
            z = f[k - 1][:, None] + move
            f[k] = np.logaddexp(z[0], z[1]) + s[k]
        for k in range(n - 2, -1, -1):
            z = move + (s[k + 1] + b[k + 1])[None, :]
            b[k] = np.logaddexp(z[:, 0], z[:, 1])
        norm = np.logaddexp(f[-1, 0], f[-1, 1])
        marginal = np.exp(f + b - norm)
        truth = np.eye(STATES)[y]
        ge += x.T @ (truth - marginal)
        if n > 1:
            pair = np.exp(f[:-1, :, None] + move[None] + (s[1:] + b[1:])[:, None, :] - norm)
            np.add.at(gm, (y[:-1], y[1:]), 1)
            gm -= pair.sum(0)
        total += n
    return ge / max(1, total), gm / max(1, total)


def train(docs: list[tuple[np.ndarray, int]], passes: int = 3, steps: int = 60, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition scores from (line features, 1 good or 0 poor); Adam on the likelihood."""
    emit, move = np.zeros((len(FEATURES), STATES)), np.zeros((STATES, STATES))
    docs = [(x, q) for x, q in docs if len(x)]
    if not {0, 1} <= {q for _, q in docs}:
        emit[0, 0] = 1.0
        return emit, move
    rng = np.random.default_rng(7)
    tags = [np.full(len(x), 1 - q) for x, q in docs]
    for turn in range(passes):
        m = [np.zeros_like(emit), np.zeros_like(move)]
        v = [np.zeros_like(emit), np.zeros_like(move)]
        for step in range(1, steps + 1):
            batch = rng.choice(len(docs), size=min(len(docs), 160), replace=False)
            grads = _gradient([(docs[k][0], tags[k]) for k in batch], emit, move)
            if turn == 0:
                grads = grads[0], 0 * grads[1]
            for w, g, mm, vv in zip((emit, move), grads, m, v):
                g = g - 1e-3 * w
                mm *= 0.9
                mm += 0.1 * g
                vv *= 0.99
                vv += 0.01 * g * g
                w += rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        if turn < passes - 1:  # poor documents' lines that look like content become content; one line at least stays
            for k, (x, q) in enumerate(docs):
                if q == 0:
                    tags[k] = ((x @ emit) @ (-1, 1) > 0).astype(int)
                    if not tags[k].any():
                        tags[k][int(np.argmax((x @ emit) @ (-1, 1)))] = 1
    return emit, move


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = SAMPLE_DOCS, where=None) -> tuple[np.ndarray, np.ndarray]:
    """Train on all lines of at most per_class labelled documents of either kind."""

    def run(parts):
        for marks, texts in parts:
            for y, t in zip(marks, texts):
                yield [(y, line_features([s for s in (t or "").split("\n") if s.strip(C.SPACE)]).astype("<f4").tobytes())]

    sample = C.labelled_sample(docs, labels, column, per_class, where)
    rows = C.map_texts(sample.select(F.col("y").alias("doc_id"), "text"), run, "y int, x binary").collect()
    rows = sorted((r["y"], bytes(r["x"])) for r in rows)
    return train([(np.frombuffer(x, "<f4").reshape(-1, len(FEATURES)).astype(float), y) for y, x in rows])


def content_share(text: str | None, emit: np.ndarray, move: np.ndarray) -> tuple[float, list[int]]:
    """Share of the words on content lines, and each non-blank line's state."""
    lines = [s for s in (text or "").split("\n") if s.strip(C.SPACE)]
    if not lines:
        return 0.0, []
    path = viterbi(line_features(lines), emit, move)
    sizes = np.array([len(s.split()) or 1 for s in lines])
    return float(sizes[path == 0].sum() / sizes.sum()), path.tolist()


def rate(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep_share: float = KEEP_SHARE) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, content_share and n_boilerplate of every document."""
    emit, move = model

    def run(parts):
        for ids, texts in parts:
            rows = []
            for i, t in zip(ids, texts):
                *figures, _ = base(t)
                failed = base_failed(figures[0], figures[4])
                share, path = content_share(t, emit, move)
                rows.append((i, *figures, failed, not failed and share >= keep_share, share, sum(path)))
            yield rows

    return C.map_texts(docs, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_boilerplate long")
