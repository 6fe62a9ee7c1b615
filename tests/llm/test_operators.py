"""The ten operators and the pipeline against brute force, on small fixtures with nulls, empties, ties and copies."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpusloom.llm import (
    bpe_lexicon,
    common,
    hnsw,
    jaccard_join,
    license_scan,
    line_dedup,
    packing,
    quality_crf,
    queries,
    secret_scan,
    suffix_dedup,
    toxicity,
)
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 300)
    words = base.split(" ")
    near = [" ".join(w if k not in at else "changed" for k, w in enumerate(words)) for at in ({5}, {9, 200}, {70, 71, 72}, set(range(0, 300, 7)))]
    lines = "\n".join(["Shared  Line", prose(2, 30), " shared  line\t"])
    out = [base, base, *near, None, "", " \t\n", "short one", "short one", lines, "The Other\n" + prose(3, 60), "x" * 700, "ab " * 400, prose(4, 40) + base[100:600], "ü" * 150 + "é" * 150, "\n\n"]
    out += ["shared  line\n" + prose(k, 12) for k in range(20, 32)]
    return [(k, t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", 3, "q") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, n int, `key` string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < 0")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 quality


def test_base_figures_against_brute_force(spark, docs, texts, nothing):
    model = quality_crf.train([])
    got = by_id(quality_crf.rate(docs, model))
    for i, t in texts:
        t = t or ""
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        hit = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines, dup = [], 0
        for s in t.split("\n"):
            if s.strip(" \t\n\x0b\x0c\r"):
                dup += s in lines
                lines.append(s)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), dup, len(hit))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert r["kept"] == (not r["base_failed"])  # the neutral model keeps what the rules keep
    assert quality_crf.rate(nothing, model).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    x, emit, move = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    import itertools

    def total(p):
        return sum((x[k] @ emit)[s] for k, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))

    assert tuple(quality_crf.viterbi(x, emit, move)) == max(itertools.product((0, 1), repeat=6), key=total)


def test_field_learns_boilerplate_lines():
    good = [prose(k, 60) + "\n" + prose(k + 500, 60) for k in range(40)]
    bad = [prose(k, 60) + "\n" + "\n".join("a | b | c | d ###" for _ in range(8)) for k in range(40)]
    data = [(quality_crf.line_features(t.split("\n")), y) for y, ts in ((1, good), (0, bad)) for t in ts]
    emit, move = quality_crf.train(data)
    assert all(quality_crf.content_share(t, emit, move)[0] == 1 for t in good)
    share, path = quality_crf.content_share(bad[0], emit, move)
    assert share < 0.65 and path[0] == 0 and all(path[1:])


def test_line_features_see_the_whole_line():
    for s in (prose(9, 200) + " BUY NOW" * 150, prose(9, 200) + " \u0130STANBUL" * 150):
        words = s.split()
        row = dict(zip(quality_crf.FEATURES, quality_crf.line_features([s])[0]))
        assert row["upper"] == min(1.0, 2 * sum(c != c.lower() for c in s) / len(s)) > 0.5
        assert row["first_upper"] == sum(w[0].isupper() for w in words) / len(words) > 0.4


# 2 nearest neighbours


def test_hnsw_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[100:400] = x[100]  # a hot vector
    big = 2**60 + 100  # divisible by 100 only as it is, not as a float
    big -= big % 100
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] + [1.0] * 15, 1), (1004, [None] + [1.0] * 15, 1), (1100, [1.0, 2.0], 1), (5, x[5].tolist(), 2), (None, x[7].tolist(), 1)]
    rows += [(600, x[601].tolist(), 3), (600, x[600].tolist(), 3), (big, x[8].tolist(), 1)]  # ids that repeat, with another vector and as a copy
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = hnsw.nearest(table, F.col("vec_id") % 100 == 0, shard_rows=300).toPandas()
    ids = np.array([i for i, v, _ in rows if i is not None and v and len(v) == 16 and all(c is not None and c == c for c in v) and any(v)])
    xs = np.array([v for i, v, _ in rows if i is not None and v and len(v) == 16 and all(c is not None and c == c for c in v) and any(v)])
    assert set(got["query_id"]) == {*range(0, 900, 100), big}
    hits = total = 0
    for (q, _), mine in got.groupby(["query_id", "query_no"]):
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine["score"].is_monotonic_increasing
        lists = []
        for at in np.flatnonzero(ids == q):  # the query's own row alone is left out
            d = np.sqrt(((xs - xs[at]) ** 2).sum(1))
            d[at] = np.inf
            lists.append(sorted(zip(d.tolist(), ids.tolist()))[:10])
        if q in (100, 200, 300):
            assert mine["vec_id"].tolist() == [i for _, i in lists[0]]  # ties to the smaller id
        hits += max(len({i for _, i in want} & set(mine["vec_id"])) for want in lists)
        total += len({i for _, i in lists[0]})
    assert hits >= 0.9 * total
    six = {n: g.sort_values("rank") for n, g in got[got["query_id"] == 600].groupby("query_no")}
    assert len(six) == 3 and sorted(g["score"].iloc[0] for g in six.values()) == [0.0, 0.0, 0.0]
    assert sorted(g["vec_id"].iloc[0] for g in six.values()) == [600, 600, 601]
    assert hnsw.nearest(table.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_shards_grow_with_rows_alone():
    assert [hnsw.shards_for(n, 12) for n in (0, 2000, 10_000, 50_000, 10**7)] == [1, 1, 4, 12, 306]


def test_recall_over_several_shards(spark):
    import duckdb

    e = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in e]), np.array([r[1] for r in e])
    table = common.load(spark, "/root/testdata/sf0.1", "embeddings")
    got = hnsw.nearest(table, F.col("vec_id") % 100 == 0, shard_rows=700).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits, total = hits + len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & set(got[got["query_id"] == q]["vec_id"])), total + 10
    assert len(ids) > 1400 and hits >= 0.9 * total


def test_recall_on_the_test_table(spark, small):
    import duckdb

    e = duckdb.sql(f"select vec_id, embedding from '{small}/embeddings.parquet' order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in e]), np.array([r[1] for r in e])
    got = queries.op2_hnsw_shards(spark, small).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, total = hits + len(want & set(got[got["query_id"] == q]["vec_id"])), total + 10
    assert hits >= 0.9 * total


# 3 line dedup


def lines_brute(texts, least, keep_first=False):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    seen, first = Counter(), {}
    for i, t in texts:
        for k in {key(s) for s in (t or "").split("\n")}:
            seen[k] += 1
            first.setdefault(k, i)
    out = {}
    for i, t in texts:
        kept, mine = [], set()
        for s in (t or "").split("\n"):
            k = key(s)
            if k and seen[k] >= least and not (keep_first and first[k] == i and k not in mine):
                continue
            mine.add(k)
            kept.append(s)
        n = len((t or "").split("\n"))
        out[i] = (n, n - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_line_dedup_both_paths(docs, texts, keep_first, limit):
    got = by_id(line_dedup.dedup(docs, keep_first=keep_first, broadcast_bytes=limit))
    want = lines_brute(texts, 10, keep_first)
    assert {i: (r["n_lines"], r["n_dropped"], r["text"]) for i, r in got.items()} == want
    assert any(v[1] for v in want.values())


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_lines_of_documents_without_ids_stay(spark, limit):
    rows = [(None, "all null\nsome null")] * 10 + [(-1, "some null\nminus one"), (7, "minus one\nseven")] + [(k, "minus one") for k in range(20, 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup(docs, keep_first=True, broadcast_bytes=limit).collect())
    assert got == Counter({(None, "all null"): 10, (-1, "some null\nminus one"): 1, (7, "seven"): 1} | {(k, ""): 1 for k in range(20, 29)})


def test_line_counts_are_reversible(docs, nothing):
    a, b = docs.where("doc_id < 20"), docs.where("doc_id >= 20")
    rows = lambda t: {(r["h1"], r["h2"]): (r["n_docs"], r["first_doc"]) for r in t.collect()}
    ra, rb = line_dedup.refcounts(a), line_dedup.refcounts(b)
    both = line_dedup.insert(ra, rb)
    assert rows(both) == rows(line_dedup.refcounts(docs))
    assert rows(line_dedup.delete(both, rb, ra)) == rows(ra)
    assert rows(line_dedup.delete(both, ra, rb)) == rows(rb)
    assert line_dedup.dedup(nothing).count() == 0


def test_cuckoo_filter_inserts_and_deletes():
    r = random.Random(2)
    keys = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(3000)]
    h = np.array(keys, np.uint64)
    f = line_dedup.Cuckoo.of(h[:, 0], h[:, 1])
    assert f.contains(h[:, 0], h[:, 1]).all()
    other = np.array([(r.getrandbits(64), r.getrandbits(64)) for _ in range(20000)], np.uint64)
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.002
    assert line_dedup.update_filter(f, [], keys[:1500])
    assert f.contains(h[1500:, 0], h[1500:, 1]).all()
    assert f.contains(h[:1500, 0], h[:1500, 1]).mean() < 0.01
    assert line_dedup.update_filter(f, keys[:1500], [])
    assert f.contains(h[:, 0], h[:, 1]).all()


# 4 licences


def dice_brute(piece, t):
    import regex

    def grams(s):
        w = regex.sub(r"[^\p{L}\p{N}]+", " ", s.lower()).strip().split(" ")
        return Counter(map(" ".join, zip(w, w[1:])))

    a, b = grams(piece), grams(t)
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_licences_against_brute_force(spark, nothing):
    texts = [None, "", "Released under the MIT License.", "intro\nReleased  under the *MIT* license\nend", "this work is licensed under the GNU general public license version 2", "Licensed under CC BY-NC 4.0. And more words follow here", "Licensed under the Apache License, Version 2.0.\n" * 2, "Release under the MIT"]
    texts.append("\n".join(t for _, t in license_scan.TEMPLATES))
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, unit int")
    got = {(r["doc_id"], r["unit"]): (r["license"], round(r["dice"], 9)) for r in license_scan.scan(docs).collect()}
    want = {}
    for i, t in enumerate(texts):
        units = [] if t is None else [*enumerate(t.split("\n")), *([(-1, t)] if "\n" in t else [])]
        for u, piece in units:
            best = min((-dice_brute(piece, x), name, k) for k, (name, x) in enumerate(license_scan.TEMPLATES))
            if -best[0] >= license_scan.THRESHOLD:
                want[i, u] = (best[1], round(-best[0], 9))
    assert got == want and len(got) > 20
    assert license_scan.scan(nothing).count() == 0


def test_licence_scan_runs_no_python(docs):
    plan = docs.sparkSession._jvm.PythonSQLUtils.explainString(license_scan.scan(docs)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def passages_brute(text, templates, t):
    import regex

    grams = lambda s: list(zip(w := regex.sub(r"[^\p{L}\p{N}]+", " ", s.lower()).strip().split(" "), w[1:]))
    g, runs, taken = grams(text), [], []
    for k, (name, x) in enumerate(templates):
        b = Counter(grams(x))
        for i in range(len(g)):
            for j in range(i, min(len(g), i + 2 * b.total())):
                common, size = (Counter(g[i : j + 1]) & b).total(), j + 1 - i
                if 2 * common / (size + b.total()) >= t:
                    runs.append((-2 * common * common / (size + b.total()), name, k, i, j, size, common, 2 * common / (size + b.total())))
    for r in sorted(runs):
        if not any(q[3] <= r[4] and r[3] <= q[4] for q in taken):
            taken.append(r)
    return {(r[3], r[5], r[1], r[6], r[7]) for r in taken}


def test_licence_passages_against_brute_force(spark, nothing):
    gpl = next(x for _, x in license_scan.TEMPLATES if x.startswith("This program is free")).split(" ")
    short = license_scan.TEMPLATES[:2] + license_scan.TEMPLATES[3:4] + license_scan.TEMPLATES[5:8] + [("Twice", "one two one two one two three")]
    texts = [None, "", "word", prose(5, 200), prose(5, 30) + "\n# " + "\n# ".join(" ".join(gpl[k : k + 10]) for k in range(0, len(gpl), 10)) + "\n" + prose(6, 60)]
    texts.append("Copyright 2020 Foo. Released under the MIT License. All code here was written by us.")
    texts.append(" ".join(x for _, x in short) + " released under the mit license" * 3 + " one two one two one two one two three one two")
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, start int")
    got = {k: set() for k in range(len(texts))}
    for r in license_scan.passages(docs, templates=short).collect():
        got[r["doc_id"]].add((r["start"], r["n_bigrams"], r["license"], r["common"], r["dice"]))
    assert got == {k: passages_brute(t or "", short, license_scan.THRESHOLD) for k, t in enumerate(texts)}
    assert [len(x) for x in got.values()][:4] == [0] * 4 and {x[2] for x in got[4]} == {"GPL-3.0"} and len(got[6]) > 8
    assert license_scan.passages(nothing).count() == 0


def test_licence_passages_wrapped_inline_and_full(spark):
    gpl = next(x for _, x in license_scan.TEMPLATES if x.startswith("This program is free")).split(" ")
    full = lambda k: prose(8, 50) + "\n\n" + license_scan.TEXTS[k][1].replace(", ", ",\n") + "\n" + prose(7, 50)
    texts = [prose(5, 40) + "\n" + "\n".join(" ".join(gpl[k : k + 11]) for k in range(0, len(gpl), 11)) + "\n" + prose(6, 60), "Copyright 2020 Foo. Released under the MIT License. All code here was written by us.", *map(full, range(4))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["license"], r["dice"]) for r in license_scan.passages(docs).collect())
    assert got == [(0, "GPL-3.0", 1.0), (1, "MIT", 1.0), (2, "MIT", 1.0), (3, "BSD-2-Clause", 1.0), (4, "BSD-3-Clause", 1.0), (5, "ISC", 1.0)]
    plan = spark._jvm.PythonSQLUtils.explainString(license_scan.passages(docs)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# 5 Jaccard join


def components_brute(sets, num=3, den=4):
    names = list(sets)
    up = {i: i for i in names}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in names:
        for b in names:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in names}


def set_of(t):
    w = [x.decode() for x in (t or "").encode().lower().split()]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_jaccard_components_against_brute_force(docs, texts, nothing):
    got = by_id(jaccard_join.components(docs))
    sets = {i: set_of(t) for i, t in texts}
    want = components_brute(sets)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert jaccard_join.components(nothing).count() == 0


def test_jaccard_large_near_group(spark):
    """One group of many near copies, chained and with outliers, beside texts that share a passage."""
    r = random.Random(9)
    base = [r.choice(WORDS) + str(r.randrange(400)) for _ in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(150)] = f"new{r.randrange(10**6)}"
        rows.append(" ".join(w))
    passage = " ".join(base[:40])
    rows += [passage + " " + " ".join(f"own{k}x{j}" for j in range(r.randrange(5, 60))) for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    want = components_brute({k: set_of(t) for k, t in enumerate(rows)})
    assert {i: x["component_id"] for i, x in by_id(jaccard_join.components(docs)).items()} == want


def test_prefixes_of_linked_sets_meet():
    r = random.Random(4)
    for _ in range(300):
        u = np.array(sorted(r.sample(range(10**6), 60)), np.int64)
        a = np.sort(u[np.array([r.random() < 0.9 for _ in u])])
        b = np.sort(u[np.array([r.random() < 0.9 for _ in u])])
        hot = np.sort(np.array(r.sample(u.tolist(), 25), np.int64))
        x, y = set(a.tolist()), set(b.tolist())
        if 4 * len(x & y) >= 3 * len(x | y):
            assert set(jaccard_join.prefix(a, hot).tolist()) & set(jaccard_join.prefix(b, hot).tolist())


# 6 BPE


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))


def test_bpe_equals_the_library(docs, texts, byte_tokenizer, nothing):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = by_id(bpe_lexicon.round_trip(docs, path, words=50))
    for i, t in texts:
        ids = byte_tokenizer.encode(t or "", add_special_tokens=False).ids
        back = byte_tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe_lexicon.round_trip(nothing, path).count() == 0
    back = by_id(bpe_lexicon.decode(bpe_lexicon.encode(docs, path, words=50), path))
    assert {i: r["text"] for i, r in back.items()} == {i: t or "" for i, t in texts}


def test_bpe_on_odd_text(byte_tokenizer):
    codec = bpe_lexicon.Codec(queries.vocabulary("byte_bpe_50k.json"), bpe_lexicon.compile_lexicon({}))
    r = random.Random(5)
    parts = list("abcXY '\"\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　éßñ01²½٣_-.!?<|>中😀́​") + ["'s", "'ll", "<|endoftext|>", "  ", " \n"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(40)))
        ids = byte_tokenizer.encode(t, add_special_tokens=False).ids
        assert list(codec.encode(t)) == ids and codec.decode(ids) == byte_tokenizer.decode(ids, skip_special_tokens=False)
    t = "ab" * 3000 + "!" * 3000
    assert list(codec.encode(t)) == byte_tokenizer.encode(t, add_special_tokens=False).ids


def test_lexicon_is_exact_and_shares_suffixes():
    entries = {f"{a}{b}ing".encode(): [k, k + 1] for k, (a, b) in enumerate((a, b) for a in WORDS for b in WORDS)}
    blob = bpe_lexicon.compile_lexicon(entries)
    lex = bpe_lexicon.Lexicon(blob)
    assert all(lex.find(w) == np.array(i, "<u4").tobytes() for w, i in entries.items())
    assert lex.find(b"alpha") is None and lex.find(b"alphabetaingx") is None and lex.find(b"") is None
    states = int(np.frombuffer(blob[:20], "<u4")[1])
    assert states < sum(map(len, entries)) / 10


# 7 secrets


def test_base_spans_against_plain_patterns(docs, nothing):
    import re

    r = random.Random(6)
    parts = ["password", "PassWD=", "secret: '", "api_key", "apikey=", "token", '"', "'", ":", "=", " ", "AKIA", "ABCDEFGH12", "0a1b2c3d4e5f", "deadbeef", "xyz-_/+.", "\n", "ſ", "ñ", "host=", "user: bob "]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert sorted(secret_scan.base_spans(t, t.lower())) == sorted(want)
        assert set(want) <= set(secret_scan.scan_text(t)[0])
    assert secret_scan.digest(secret_scan.scan(nothing)).count() == 0


def test_weak_parts_need_a_partner():
    weak = "host=db.internal.example and user: alice"
    assert [k for k, *_ in secret_scan.scan_text(weak)[0]] == ["endpoint", "name"]  # identifier and endpoint complement
    assert secret_scan.scan_text("user: alice alone")[0] == []
    far = "user: alice " + "word " * 100 + "password=abcdefgh1234"
    assert [k for k, *_ in secret_scan.scan_text(far)[0]] == ["assign"]
    near = "user: alice password=abcdefgh1234"
    assert [k for k, *_ in secret_scan.scan_text(near)[0]] == ["name", "assign"]
    assert secret_scan.redact(near, secret_scan.scan_text(near)[0]) == "[name] [assign]"


def test_links_against_all_pairs():
    r = random.Random(8)
    for _ in range(300):
        parts = [(r.choice(secret_scan.KINDS), a := r.randrange(2000), a + r.randrange(1, 60)) for _ in range(r.randrange(2, 14))]
        found = dict(secret_scan.linked(parts, 100))
        for k, (kind, a, b) in enumerate(parts):
            gaps = [max(0, c - b, a - d) for other, c, d in parts if secret_scan.ROLE[other] != secret_scan.ROLE[kind]]
            assert (k in found) == bool(gaps and min(gaps) <= 100)


# 8 packing


def test_packing_is_whole_and_tight(docs, texts, nothing):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, capacity=128).toPandas()
    want = {}
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 128)):
            part = ids[a : a + 128]
            want[i, k] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 128
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 128) + 2
    assert packing.pack_documents(nothing, path).count() == 0


def test_best_two_fit_places_every_piece_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 3000):
        lengths = rng.integers(1, 1001, n)
        where, offset = packing.best_two_fit(lengths, 1000)
        for b in range(int(where.max(initial=-1)) + 1):
            at = np.flatnonzero(where == b)
            at = at[np.argsort(offset[at])]
            assert offset[at].tolist() == [0, *np.cumsum(lengths[at])[:-1]][: len(at)] and lengths[at].sum() <= 1000
    assert len(set(where.tolist())) <= 1.01 * lengths.sum() / 1000 + 1
    # the smallest piece makes room for two that fit more tightly: 6 + 3 leaves 1, 6 + 2 + 2 leaves none
    where, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert len(set(where[[0, 2, 3]].tolist())) == 1 and where[1] != where[0]


# 9 suffix arrays


def repeats_brute(texts, size):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(r[k : k + size] for r in raw for k in range(len(r) - size + 1))
    out = {}
    for (i, _), r in zip(texts, raw):
        gone = {j for k in range(len(r) - size + 1) if seen[r[k : k + size]] > 1 for j in range(k, k + size)}
        spans = sum(j - 1 not in gone for j in gone)
        out[i] = (len(r), len(gone), spans, bytes(b for j, b in enumerate(r) if j not in gone))
    return out


def test_repeats_against_brute_force(docs, texts, nothing, monkeypatch):
    for block in (512, 3):
        monkeypatch.setattr(suffix_dedup, "BLOCK_RUNS", block)
        got = by_id(suffix_dedup.dedup(docs))
        want = repeats_brute(texts, 200)
        assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in got.items()} == want
    assert suffix_dedup.dedup(nothing).count() == 0


def test_first_occurrence_stays(docs, texts):
    got = by_id(suffix_dedup.dedup(docs, keep="first"))
    raw = {i: (t or "").encode() for i, t in texts}
    seen, gone = set(), {i: set() for i in raw}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 199):
            w = raw[i][k : k + 200]
            if w in seen:
                gone[i].update(range(k, k + 200))
            seen.add(w)
    assert {i: r["n_removed"] for i, r in got.items()} == {i: len(g) for i, g in gone.items()}


def test_longest_previous_factors_against_brute_force():
    r = random.Random(7)
    s = "".join(r.choice("ab") for _ in range(120))
    order = np.array(sorted(range(120), key=lambda k: s[k:]))

    def common(a, b):
        n = 0
        while max(a, b) + n < 120 and s[a + n] == s[b + n]:
            n += 1
        return n

    near = np.array([0, *(common(a, b) for a, b in zip(order, order[1:]))])
    got = dict(zip(order.tolist(), suffix_dedup.longest_previous_factors(order, near).tolist()))
    assert got == {i: max((common(i, j) for j in range(i)), default=0) for i in range(120)}


# 10 toxicity


def labelled(n, seed):
    r = random.Random(seed)
    bad = ["worthless", "pathetic", "moron"]
    out = []
    for k in range(n):
        t = prose(seed * 10_000 + k, 60)
        y = int(k % 5 == 0)
        if y:
            w = t.split(" ")
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
            t = " ".join(w)
        out.append((k, t, y))
    return out


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = labelled(300, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_toxicity_on_held_out_texts(spark, toxic_model, nothing):
    rows = labelled(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, prose(77, 5000))], "doc_id long, text string")
    got = by_id(toxicity.score(docs, toxic_model))
    assert np.mean([(got[i]["score"] >= 0.5) == (y == 1) for i, _, y in rows]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["score"] == got[901]["score"] < 0.5 and got[902]["score"] < 0.5
    assert toxicity.score(nothing, toxic_model).count() == 0


def test_toxicity_tolerates_gaps(toxic_model):
    scorer = toxicity.Scorer(toxic_model)

    def value(word):
        scorer.learn({word})
        return scorer.cache[word]

    assert value("w-o-rthless") > 0 and value("wortthless") > 0 and value("path.etic") > 0
    assert max(value(w) for w in WORDS) < 0
    assert "moron" in toxicity.tokens_of("you m o r o n there")


def test_pair_values_equal_the_kernel_of_joined_words():
    table = np.random.default_rng(3).normal(size=toxicity.SIZE)
    for words in (["a", "b"], ["a", "b", "idi", "ot", "worth", "less", "ü", "x" * 40, "a", "bc", "d"]):
        assert np.allclose(toxicity.pair_values(words, table), toxicity.apply_weights([f"{a} {b}" for a, b in zip(words, words[1:])], table))


def test_toxicity_crosses_blanks(spark, toxic_model):
    clean = [prose(k, 60) for k in range(700, 760)]
    split = ["wor thless", "worth less", "pathe tic", "mor on", "worthl ess"]
    texts = [t + f" {split[k % 5]} and {split[(k + 1) % 5]} " + t for k, t in enumerate(clean)] + clean
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(toxicity.score(docs, toxic_model))
    assert np.mean([got[k]["score"] >= 0.5 for k in range(60)]) >= 0.9
    assert np.mean([got[k]["score"] >= 0.5 for k in range(60, 120)]) <= 0.05


def test_toxicity_learns_phrases_of_harmless_words(spark):
    def text(k, y):  # every word is as frequent in clean texts; the pair is not
        w = prose(k, 60).replace(".", "").replace(",", "").split(" ")
        for at in (7, 40):
            w[at:at] = ["wither", "quickly"] if y else ["quickly", *w[at : at + 3], "wither"]
        return " ".join(w)

    rows = [(k, text(9000 + k, int(k % 4 == 0)), int(k % 4 == 0)) for k in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    new = [(k, text(20_000 + k, k % 2)) for k in range(100)]
    got = by_id(toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model))
    assert np.mean([(got[k]["score"] >= 0.5) == (k % 2 == 1) for k, _ in new]) >= 0.95


def test_collapsed_weights_equal_the_landmark_kernel():
    landmarks, words = ["idiot", "alpha", "moron"], ["idioot", "beta", "mo.ron", "alphabet"]
    k = toxicity.kernel(words, landmarks)
    table = np.zeros(toxicity.SIZE)
    alpha = np.array([0.5, -1.0, 2.0])
    norm = toxicity.norms(landmarks)
    for who, u, d in toxicity._occurrences(landmarks):
        np.add.at(table, u, d * (alpha / norm)[who])
    assert np.allclose(toxicity.apply_weights(words, table), k @ alpha, atol=1e-5)


def test_no_labels_no_model(spark, docs):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model is None and {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}


# shared parts and the pipeline


def test_connected_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)]
    comp, _ = common.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = {i: root(i) for a, b in pairs if a != b for i in (a, b) if root(i) != i}
    assert {x["node"]: x["component"] for x in comp.collect()} == want


def test_connected_components_that_do_not_settle(spark):
    with pytest.raises(RuntimeError, match="did not settle in 2 rounds"):
        common.connected_components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long"), rounds=2)


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = common.load(spark, small, "documents").withColumn("extra", F.lit("x"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stash(stage(spark, docs, small))
        assert out.columns == docs.columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if name == "line dedup":
            want = {i: t for i, (_, k, t) in lines_brute(sorted(before.items()), 10, True).items() if not k or t.strip()}
            assert after == want
        if name == "n-gram Jaccard join":
            comp = components_brute({i: set_of(t) for i, t in before.items()})
            assert set(after) == {i for i in before if comp[i] == i}
        if name == "secret scans":
            assert after == {i: secret_scan.redact(t, secret_scan.scan_text(t)[0]) for i, t in before.items()}
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_on_an_empty_table(spark, small):
    import corpus_pipeline

    docs = common.load(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
