"""Every operator and stage on odd rows: null ids, ids beyond 2^53, ids that repeat, texts of megabytes, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpusloom.llm import (
    bpe_lexicon,
    common,
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

BIG = 2**60 + 1
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
FIELDS = "doc_id long, text string, _kept string, kept string, hit boolean, t1 long, id string, `none` int, length long, piece string, shard int, n_chars int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    long = "\n".join(prose(k, 60) + f" tail{r.random()}" for k in range(7000))  # some 2.5 MB
    one_line = " ".join(prose(50_000 + k, 100) + f" mark{r.random()}" for k in range(2500))  # 1.4 MB without a line break
    base = prose(901, 120)
    return [
        (BIG, base), (BIG + 1, base + " more"), (None, base), (None, base), (None, None), (None, ""), (BIG, "another text under one id " + prose(7, 80)),
        (BIG, base), (-1, prose(5, 90)), (-(2**62), prose(5, 90) + " x"), (0, long), (BIG + 2, one_line), (BIG + 3, "   \n\t "), (None, prose(11, 70)),
        (BIG + 4, "password = abcdefgh12345678 user: bob"), (None, "password = abcdefgh12345678 user: bob"), (5, "ab" * 300_000),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "mine", "own", True, 7, "x", 1, 99, "p", 3, 12) for i, t in texts]
    return spark.createDataFrame(rows, FIELDS).repartition(3).cache()


def counted(rows):
    return Counter(rows)


def test_quality(docs, texts):
    model = quality_crf.train([])
    got = counted((r["doc_id"], r["n_words"], r["word_chars"]) for r in quality_crf.rate(docs, model).collect())
    assert got == counted((i, len((t or "").split()), sum(map(len, (t or "").split()))) for i, t in texts)


def test_quality_reads_tails(spark):
    lines = [prose(k, 60) for k in range(450)]
    junk = [*lines, *(["### | $$$ | %%% | BUY"] * 300)]
    model = quality_crf.train([(quality_crf.line_features(x), y) for x, y in ((lines, 1), (junk, 0), (lines[:50], 1), (junk[-50:], 0)) for _ in range(3)])
    assert quality_crf.content_share("\n".join(lines), *model)[0] == 1
    assert quality_crf.content_share("\n".join(junk), *model)[1][-300:] == [1] * 300  # what lies past line 400 was learned from


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_line_dedup(spark, docs, texts, limit):
    out = line_dedup.with_kept(docs, min_docs=3, keep_first=True, broadcast_bytes=limit)
    assert out.columns[:-1] == docs.columns
    kept = out.columns[-1]
    rows = [(r["doc_id"], r["text"], r["_kept"], r["kept"], r[kept]["n_dropped"], r[kept]["text"]) for r in out.collect()]
    assert all(x[2:4] == ("mine", "own") for x in rows)
    base = texts[0][1]  # four rows have it as a line: it stays in those of the smallest id
    assert counted((i, n) for i, t, _, _, n, _ in rows if t == base) == Counter({(BIG, 0): 2, (None, 1): 2})
    assert all(left == (t or "") for i, t, _, _, n, left in rows if n == 0)


def test_line_index_goes_both_ways(spark, docs):
    a, b = docs.where("doc_id is null or doc_id < 100").select("doc_id", "text"), docs.where("doc_id >= 100").select("doc_id", "text")
    shards = lambda x: {r["shard"]: (bytes(r["h1s"]), bytes(r["h2s"]), bytes(r["firsts"])) for r in x.found.collect() if r["h1s"]}
    rows = lambda x: {(r["h1"], r["h2"]): (r["n_docs"], r["first_doc"]) for r in x.table.collect()}
    first = line_dedup.LineIndex.of(a, 2)
    both = first.insert(b)
    whole = line_dedup.LineIndex.of(docs, 2)
    assert rows(both) == rows(whole) and shards(both) == shards(whole)
    assert shards(both) != shards(first)
    back = both.delete(b, left=a)
    assert rows(back) == rows(first) and shards(back) == shards(first)
    for index in (both, back):  # every exact key is in its shard's filter
        for r in index.found.collect():
            s = line_dedup.Shard(*(bytes(r[k]) for k in ("cuckoo", "h1s", "h2s", "firsts")))
            assert s.cuckoo.contains(s.h1.view(np.uint64), s.h2.view(np.uint64)).all()
            assert (s.cuckoo.table != 0).sum() == len(s.h1)
    want = sorted((r["n_dropped"], r["text"]) for r in line_dedup.dedup(docs, 2).collect())
    for limit in (1 << 26, 0):
        got = sorted((r["n_dropped"], r["text"]) for r in line_dedup.dedup(docs, index=both, broadcast_bytes=limit).collect())
        assert got == want


def test_lines_routed_to_several_deals(docs, monkeypatch):
    want = sorted((r["n_dropped"], r["text"]) for r in line_dedup.dedup(docs, 2).collect())
    monkeypatch.setattr(line_dedup, "ROUTE_ROWS", 20)  # a shard's lines meet several copies of its filter
    assert sorted((r["n_dropped"], r["text"]) for r in line_dedup.dedup(docs, 2, broadcast_bytes=0).collect()) == want


def test_a_failing_insert_leaves_the_filter_as_it_was():
    r = random.Random(2)
    f = line_dedup.Cuckoo(table=np.zeros((4, line_dedup.SLOTS), np.uint16))
    held, failed = [], 0
    for _ in range(60):
        key = (r.getrandbits(64), r.getrandbits(64))
        before = f.table.copy()
        if f.insert(*key):
            held.append(key)
        else:
            failed += 1
            assert (f.table == before).all()
    h = np.array(held, np.uint64)
    assert failed and f.contains(h[:, 0], h[:, 1]).all()


def test_licences(docs):
    got = license_scan.scan(docs)
    assert got.count() == 0 and license_scan.passages(docs).count() == 0


def set_of(t):
    w = [x.decode() for x in (t or "").encode().lower().split()]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))


def linked(texts):
    """Groups of rows' numbers by links."""
    sets = [set_of(t) for _, t in texts]
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(root(k), []).append(k)
    return sets, list(groups.values())


def test_jaccard(docs, texts):
    sets, groups = linked(texts)
    want = Counter()
    for g in groups:
        named = [texts[k][0] for k in g if texts[k][0] is not None]
        for k in g:
            own = texts[k][0]
            want[own, len(sets[k]), min(named) if named and sets[k] else own] += 1
    got = counted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect())
    assert got == want


def test_one_row_of_each_group_stays(docs, texts):
    _, groups = linked(texts)
    out = jaccard_join.keep_one(docs)
    assert out.columns == docs.columns
    got = counted((r["doc_id"], r["text"]) for r in out.collect())
    for g in groups:
        rows = [texts[k] for k in g]
        left = [x for x in rows if got[x]]
        if not set_of(rows[0][1]):
            continue
        assert sum(got[x] for x in set(rows)) == 1
        named = [i for i, _ in rows if i is not None]
        assert left[0][0] == (min(named) if named else None)
    assert got[None, None] == got[None, ""] == 1 and got[BIG + 3, "   \n\t "] == 1
    assert sum(got.values()) == sum(1 if set_of(texts[g[0]][1]) else len(g) for g in groups)
    assert len({t for i, t in got if i == BIG}) == 2  # different texts under one id


def test_classes_with_equal_halves_are_told_apart(spark, monkeypatch):
    plain = jaccard_join.name_of

    def poor(raw):
        a, b = plain(raw)
        return a & 3, b

    monkeypatch.setattr(jaccard_join, "name_of", poor)
    rows = [(k, prose(k // 2, 60) + (" z" if k % 2 else "")) for k in range(24)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(jaccard_join)
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(table).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(jaccard_join)
    assert got == {k: k - k % 2 for k in range(24)}


def test_bpe(docs, texts):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = counted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_lexicon.round_trip(docs, path, words=200).collect())
    assert got == want


def test_chunks_are_counted_once_and_for_all(spark, docs, texts, monkeypatch):
    want = Counter(w for _, t in texts if t for w in bpe_lexicon.CHUNK.findall(t) if len(w) <= bpe_lexicon.LONGEST)
    for parts in (1, 5):
        got = {r["chunk"]: r["n"] for r in bpe_lexicon.chunk_counts(docs.repartition(parts)).collect()}
        assert got == dict(want)
    top = {r["chunk"] for r in bpe_lexicon.frequent_chunks(docs, 20).collect()}
    least = min(want[w] for w in top)
    assert len(top) <= 20 and top == {w for w, n in want.items() if n >= least}


def test_secrets(docs, texts):
    want = Counter()
    for i, t in texts:
        spans, _ = secret_scan.scan_text(t)
        line = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        base = [s for s in spans if s[0] in secret_scan.BASE]
        want[i, *(sum(s[0] == k for s in spans) for k in secret_scan.BASE), hashlib.sha256(line(base).encode()).hexdigest(), line(spans)] += 1
    got = counted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in secret_scan.digest(secret_scan.scan(docs)).collect())
    assert got == want and any("name:" in x[-1] for x in got)
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns
    assert counted((r["doc_id"], r["text"], r["kept"]) for r in out.collect()) == counted((i, secret_scan.redact(t, secret_scan.scan_text(t)[0]), "own") for i, t in texts)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())] += 1
    for rows in (20_000, 30):  # several shards too
        got = packing.pack_documents(docs, path, shard_rows=rows).collect()
        assert counted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        filled = {}
        for r in got:
            filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in filled.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 4096


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffixes(docs, texts, keep):
    small = docs.where("length(text) < 100000 or text is null")
    few = [(i, (t or "").encode()) for i, t in texts if len(t or "") < 100_000]
    got = counted((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.dedup(small, keep=keep).collect())
    if keep == "none":
        seen = Counter(r[k : k + 200] for _, r in few for k in range(len(r) - 199))
        want = Counter()
        for i, r in few:
            gone = {j for k in range(len(r) - 199) if seen[r[k : k + 200]] > 1 for j in range(k, k + 200)}
            want[i, len(r), len(gone), bytes(b for j, b in enumerate(r) if j not in gone)] += 1
        assert got == want
    else:
        assert sum(got.values()) == len(few) and {x[0] for x in got} == {i for i, _ in few}


def test_suffixes_of_megabytes(docs, texts):
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(docs.where("length(text) > 100000")).collect()}
    assert got[0, len(texts[10][1].encode())] == (0, 0) and got[5, 600_000] == (600_000, 1)


def test_suffix_order_against_sorted_windows():
    r = random.Random(5)
    for size in (8, 13, 40, 200):
        text = bytes(r.choice(b"ab") for _ in range(300)) + bytes(r.choice(b"abcd") for _ in range(400)) * 2
        ranks = suffix_dedup.ranks_of(np.frombuffer(text, np.uint8), size)
        at = np.arange(len(text) - size + 1)
        order = at[np.argsort(ranks[-1][1][at], kind="stable")]
        assert [text[k : k + size] for k in order] == sorted(text[k : k + size] for k in at)
        common = suffix_dedup.common_prefixes(ranks, order[1:], order[:-1])
        for p, q, c in zip(order[1:].tolist(), order[:-1].tolist(), common.tolist()):
            n = next((k for k in range(size) if text[p + k] != text[q + k]), size)
            assert c == n if n == size else c <= n


def test_toxicity(spark, docs, texts):
    bad = [(k, prose(k, 40) + (" you moron idiot" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(80)]
    model = toxicity.fit(spark.createDataFrame([x[:2] for x in bad], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in bad], "doc_id long, toxic int"))
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()]
    assert counted(i for i, _ in got) == counted(i for i, _ in texts) and all(0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i == BIG}) <= 2  # equal rows, equal scores
    kept = toxicity.below(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for _, s in got)
    odd = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" moron idiot moron")).alias("text"), F.lit(1).alias("score"))
    assert toxicity.below(odd.where("length(text) < 5000"), model, 0.5).count() == 0


def test_kernel_against_enumerated_subsequences():
    def plain(word):
        points = [61, *(int(toxicity._CODE[ord(c)]) for c in word), 62]
        out = Counter()
        for i in range(len(points)):
            for j in range(i + 1, len(points)):
                for k in range(j + 1, len(points)):
                    if k - i < toxicity.SPAN:
                        out[points[i], points[j], points[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    def by_occurrence(word):  # what the norm is taken of: each occurrence by itself
        n = len(word) + 2
        return sum(toxicity.DECAY ** (2 * (k - i - 2)) for i in range(n) for k in range(i + 2, min(n, i + toxicity.SPAN)) for _ in range(i + 1, k))

    words, landmarks = ["idiot", "id-iot", "idi ot", "moron", "a", "mo"], ["idiot", "moron", "id"]
    got = toxicity.kernel(words, landmarks)
    for a, w in enumerate(words):
        for b, v in enumerate(landmarks):
            x, y = plain(w), plain(v)
            want = sum(x[u] * y[u] for u in x) / np.sqrt(max(by_occurrence(w), 1e-12) * max(by_occurrence(v), 1e-12))
            assert np.isclose(got[a, b], want)


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_stages(spark, docs, texts, small):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stash(stage(spark, docs, small))
        assert out.columns == docs.columns and out.schema == docs.schema
        rows = out.collect()
        assert all((r["_kept"], r["kept"], r["id"]) == ("mine", "own", "x") for r in rows)
        got = counted((r["doc_id"], r["text"]) for r in rows)
        if name == "toxicity":
            assert set(got) <= set(texts)
        if name == "line dedup":
            assert got == counted((i, t or "") for i, t in texts)  # no line is in ten rows; a null text is an empty one
        if name == "n-gram Jaccard join":
            assert {t for _, t in got if t} < {t for _, t in texts if t} and len({t for i, t in got if i == BIG}) == 2
        if name == "secret scans":
            assert not any(t and "abcdefgh1234" in t for _, t in got) and sum(got.values()) == len(texts)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert counted(r["doc_id"] for r in last.where("piece = 0").collect()) == counted(i for i, _ in texts)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name


def test_trained_field_end_to_end(spark):
    """Fit on labelled documents, rate others: the verdict is that of the best of all paths, enumerated."""
    import itertools

    def text(k, good):
        r = random.Random(k)
        lines = [prose(1000 * k + j, 25) for j in range(r.randrange(2, 5))]
        return "\n".join(lines if good else [*lines[:2], *("Menu | Home | Login ###" + str(j) for j in range(r.randrange(2, 5)))])

    rows = [(k, text(k, k % 2 == 0), k % 2 == 0) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows], "doc_id long, quality int")
    emit, move = model = quality_crf.fit(docs, labels)
    new = [(k, text(k, k % 2 == 0)) for k in range(100, 130)]
    got = {r["doc_id"]: r for r in quality_crf.rate(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    for k, t in new:
        lines = t.split("\n")
        x = quality_crf.line_features(lines) @ emit
        best = max(itertools.product((0, 1), repeat=len(lines)), key=lambda p: sum(x[j, s] for j, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])))
        sizes = [len(s.split()) for s in lines]
        share = sum(n for n, s in zip(sizes, best) if s == 0) / sum(sizes)
        assert np.isclose(got[k]["content_share"], share) and got[k]["n_boilerplate"] == sum(best)
        assert got[k]["kept"] == (not got[k]["base_failed"] and share >= quality_crf.KEEP_SHARE)
    assert np.mean([got[k]["n_boilerplate"] > 0 for k in range(101, 130, 2)]) > 0.9 > 0.1 > np.mean([got[k]["n_boilerplate"] > 0 for k in range(100, 130, 2)])


def test_columns_of_any_type_pass_through(spark):
    import datetime
    from decimal import Decimal

    base = prose(1, 60)
    rows = [(k, base if k < 4 else prose(k, 50) + "\npassword = abcdefgh12345678", datetime.datetime(2020, 1, k + 1, 5), datetime.date(2020, 1, 1), Decimal("1.25"), ["a", None], {"k": k}, (k, ["x"]), bytearray(b"z"), 1.5) for k in range(8)]
    kinds = "doc_id int, text string, ts timestamp, d date, dec decimal(10,2), arr array<string>, m map<string, int>, st struct<a: int, b: array<string>>, bin binary, x float"
    docs = spark.createDataFrame(rows, kinds)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        want = {r["doc_id"]: r.asDict(True) for r in docs.drop("text").collect()}
        model = toxicity.fit(spark.createDataFrame([(k, prose(k, 30) + (" moron" if k % 2 else "")) for k in range(20)], "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int"))
        for out in (toxicity.below(docs, model, 1.1), secret_scan.redacted(docs), jaccard_join.keep_one(docs), line_dedup.with_kept(docs, 3), line_dedup.with_kept(docs, 3, broadcast_bytes=0)):
            names = [c for c in docs.columns if c != "text"]
            assert out.select(*docs.columns).schema == docs.schema
            got = {r["doc_id"]: r.asDict(True) for r in out.select(*names).collect()}
            assert got and all(got[k] == want[k] for k in got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
