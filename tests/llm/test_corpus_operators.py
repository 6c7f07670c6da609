"""Operators on whole corpora against brute force: near duplicates, repeated text, top products, benchmark leaks, URL lists."""

import collections
import hashlib
import os
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablekit.functions.session import shared_root
from tablekit.llm import benchmark_leaks, near_duplicates, repeated_text, suffixes, top_products, urls

WORD = near_duplicates._WORD


def read(rows):
    return sorted((str(tuple(r)) for r in rows))


# Repeated text


def brute_repeated(rows):
    first = {}
    for d, t in rows:
        b, k = (t or "").encode(), repeated_text.NULL_ID if d is None else d
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 1 << 63), k)
    out = []
    for d, t in rows:
        b, k = (t or "").encode(), repeated_text.NULL_ID if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(3)
    syllables = ["th", "on", "er", "ing", "ñ", "the ", "of ", "was ", "a ", "é", "Ha "]
    text = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    common = [text(rng.randint(5, 120)) for _ in range(25)]
    rows = [(i, "".join(rng.choice([text(rng.randint(0, 60)), rng.choice(common)]) for _ in range(rng.randint(0, 8)))) for i in range(200)]
    rows += [(600, None), (601, ""), (None, common[0] * 2), (None, common[0] * 2), (5, common[1] * 3), (602, "Ha " * 400), (603, "Ha " * 500)]
    rows += [(604, "a" * 49), (605, "a" * 50), (606, "a" * 300), (7, rows[7][1])]
    rows += [(700 + i, text(40) + common[3] + common[4] + text(50)) for i in range(80)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("many, size", [(1_024, 24_000_000), (2, 10_000)])
def test_repeated_text(spark, monkeypatch, many, size):
    monkeypatch.setattr(repeated_text, "MANY", many)
    monkeypatch.setattr(repeated_text, "ROUND", size)
    monkeypatch.setattr(repeated_text, "SLICE", min(size, 1_500_000) // 2)
    rows = passages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, N_Bytes int").repartition(5)
    assert read(repeated_text.repeated_bytes(df).collect()) == read(brute_repeated(rows))
    kept = repeated_text.without_repeated_bytes(df)
    assert kept.columns == df.columns and kept.count() == len(rows) and kept.filter("text is null").count() == 1
    assert repeated_text.repeated_bytes(df.limit(0)).count() == 0


def shown_bucket(pieces, width):
    """pieces(doc, row, start, bytes, part) as a task shows them to the bucket 0."""
    doc, row, start, text, part = zip(*sorted(pieces))
    head = repeated_text.to_blob(*(np.array(x) for x in (doc, row, start, [len(t) for t in text], part)))
    body = zstandard.ZstdCompressor().compress(b"".join(text))
    return pa.table({"target": pa.array([width], pa.int64()), "kind": pa.array([1], pa.int32()), "blob": [len(head).to_bytes(4, "little") + head + body]})


def test_shown_text_is_sorted_in_parts(monkeypatch):
    """However much is shown in a bucket, a task sorts a bounded number of windows at once, and finds the same."""
    rng = random.Random(4)
    core = [bytes(rng.choice(b"abcdefgh") for _ in range(60)) for _ in range(300)]
    pieces = [(d, d + 1_000, 7, core[d % 300] + bytes([65 + d // 300]) * 10, (d % 300) * 31 % 256) for d in range(900)]
    sizes, sort = [], repeated_text.equal_groups
    monkeypatch.setattr(repeated_text, "equal_groups", lambda data, at: sizes.append(len(at)) or sort(data, at))

    def gone():
        out = repeated_text.sort_shown(8)(shown_bucket(pieces, 8)).to_pylist()
        rows = [repeated_text.from_blobs([r["blob"]], 3) for r in out]
        return sorted((r["target"], *x) for r, own in zip(out, rows) for x in zip(*(a.tolist() for a in own)))

    monkeypatch.setattr(repeated_text, "SORTED", 10**9)
    whole = gone()
    assert {x[1] for x in whole} == {d + 1_000 for d in range(300, 900)} and {x[2:] for x in whole} == {(7, 67)}
    del sizes[:]
    monkeypatch.setattr(repeated_text, "SORTED", 1_000)
    assert gone() == whole and len(sizes) > 10 and max(sizes) < 4_000 < sum(sizes)


def test_cores_are_answered_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    doc, key, around = np.sort(rng.integers(0, 50, 4_000)), rng.integers(0, 500, 4_000), rng.integers(0, 3, 4_000)
    blobs = [repeated_text.to_blob(*(x[k::4].copy() for x in (doc, key, around))) for k in range(4)]
    table = pa.table({"target": pa.array([3] * 4, pa.int64()), "kind": pa.array([0] * 4, pa.int32()), "blob": blobs})

    def told():
        out = repeated_text.answer(8)(table).to_pylist()
        read = [(r["target"], *repeated_text.from_blobs([r["blob"]], 2)) for r in out]
        return sorted((t, *x) for t, joint, act in read for x in zip(joint.tolist(), act.tolist())), max(len(joint) for _, joint, _ in read)

    whole, most = told()
    monkeypatch.setattr(repeated_text, "ANSWERED", 1_000)
    parts, less = told()
    assert parts == whole and less < most / 4


def test_documents_are_dealt_out_once(spark):
    """One shuffle of the documents serves both their answers and their end, nothing else is written, and neighbouring pieces
    leave as one."""
    text = " ".join(f"{k * k}" for k in range(400))
    df = spark.createDataFrame([(1, text), (2, text), (3, "other " * 40)], "doc_id long, text string")
    before = set(os.listdir(shared_root(spark).removeprefix("file:")))
    got = repeated_text.repeated_bytes(df)
    assert read(got.collect()) == read(brute_repeated([tuple(r) for r in df.collect()]))
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in set(os.listdir(shared_root(spark).removeprefix("file:"))) - before if x.startswith("shown-text")]
    row, start, stop = repeated_text.joined(np.array([9, 4, 4, 9, 4]), np.array([0, 0, 40, 100, 200]), np.array([60, 50, 90, 150, 250]))
    assert list(zip(row.tolist(), start.tolist(), stop.tolist())) == [(4, 0, 90), (4, 200, 250), (9, 0, 60), (9, 100, 150)]


def test_deep_shallow_sorting():
    rng = random.Random(9)
    parts = ["".join(rng.choice("ab") for _ in range(rng.choice([5, 30, 45]))) for _ in range(12)]
    data = "".join(rng.choice(parts) for _ in range(150)).encode() + b"x" * 50
    starts = np.array(rng.sample(range(len(data) - 50), 800))
    order, group = suffixes.equal_groups(np.frombuffer(data, np.uint8), starts)
    strings = [data[starts[i] : starts[i] + 50] for i in order]
    assert strings == sorted(strings)
    assert all((a == b) == (x == y) for a, b, x, y in zip(strings, strings[1:], group, group[1:]))


# Near duplicates


def aligned(a, b):
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[-1]))
        before = now
    return before[-1]


def brute_classes(rows):
    words = [tuple(WORD.findall((t or "").lower())) for _, t in rows]
    labels = near_duplicates.labelled_shingles(pa.array([t or "" for _, t in rows], pa.large_string()))
    sketches = [set(near_duplicates.sketches(x).tolist()) for x in labels]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = words[i], words[j]
            same = words[i] == words[j] if words[i] or words[j] else (rows[i][1] or "") == (rows[j][1] or "")
            if not same and a and b and sketches[i] & sketches[j]:
                m = aligned(a, b)
                same = m / (len(a) + len(b) - m) >= 0.8 - 1e-12
            if same:
                parent[root(i)] = root(j)
    members = collections.defaultdict(list)
    for i, r in enumerate(rows):
        members[root(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        own = members[root(i)]
        least = min((d for d in own if d is not None), default=None)
        out.append((r[0], least, len(own), least is not None and r[0] == least))
    return out


def edited():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0.005, 0.01, 0.02, 0.04]))):
                p = rng.randrange(len(copy))
                copy[p : p + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[p], rng.choice(vocabulary)]])
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(900, None), (901, ""), (902, "   "), (903, "--"), (904, "--"), (905, "One two"), (906, "one, TWO!"), (None, "one two")]
    rows += [(None, "q r s t u v"), (None, "q r s t u v"), (3, rows[3][1]), (7, "entirely different text here with more words")]
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    rows = edited()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Node string").repartition(4)
    expected = brute_classes(rows)
    assert read(near_duplicates.near_duplicates(df).collect()) == read(expected)
    kept = near_duplicates.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == {c for _, c, _, _ in expected if c is not None}
    clashing = df.selectExpr("doc_id", "text", "1 as keep_id_0", "2 as `KEEP_ID`", "3 as node_0", "4 as keep_node")
    assert sorted(r["doc_id"] for r in near_duplicates.without_near_duplicates(clashing).collect() if r["doc_id"] is not None) == sorted(i for i in ids if i is not None)
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_class_where_ids_tell_rows_apart(spark, monkeypatch):
    """Rows without repeated ids, with a field of bits so small that most ids look wanted, and with clashing names."""
    monkeypatch.setattr(near_duplicates, "SIEVE", 64)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(500) if i % 3 else 1}x{j if i % 3 == 0 else rng.randrange(900)}" for j in range(30))) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, "of no id"), (301, None)], "doc_id long, text string").selectExpr("doc_id", "text", "1 as Word_0", "2 as bits_0", "3 as keep_id_0")
    kept = near_duplicates.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((d is None, d or 0, t or "") for d, t in [*[r for r in rows if r[0] % 3 or r[0] == 0], (None, "of no id"), (301, None)])


def test_similarity_of_a_long_text_and_its_edit():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 5_000, 120_000).astype(np.uint64)
    b = np.delete(a, rng.choice(len(a), 9_000, replace=False))
    assert near_duplicates.similarity(a, b) == pytest.approx(len(b) / len(a))
    assert near_duplicates.similarity(a, b[: len(b) // 2]) == 0


@pytest.mark.parametrize("band, short", [(48, 8_192), (1, 0), (3, 8_192)])
def test_similarity_is_that_of_a_whole_table(monkeypatch, band, short):
    monkeypatch.setattr(near_duplicates, "BAND", band)
    monkeypatch.setattr(near_duplicates, "SHORT", short)
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(rng.choice([3, 30])) for _ in range(rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randint(0, 2)] = [rng.randrange(30) for _ in range(rng.randint(0, 2))]
        m = aligned(a, b)
        want = m / (len(a) + len(b) - m) if a or b else 0.0
        got = near_duplicates.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == (pytest.approx(want) if want >= 0.8 - 1e-12 else 0.0)


def test_near_copies_are_found(spark):
    """Copies with up to 6 % of their words edited: at least nine of ten are in the class of their original."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3_000)]
    rows = []
    for k in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 300))]
        copy = list(base)
        for _ in range(max(1, int(len(base) * 0.06))):
            p = rng.randrange(len(copy))
            copy[p : p + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[p], rng.choice(vocabulary)]])
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    found = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(150)) >= 135
    assert all(found[2 * k] == 2 * k for k in range(150))


def test_null_ids_do_not_multiply(spark):
    """Rows without an id, and rows of one id, are looked at once each."""
    rows = [(None if i % 2 else 7, " ".join(f"w{i // 2}x{j}" for j in range(12))) for i in range(3_000)]
    start = time.time()
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.groupBy("class_size").count().collect() == [(2, 3_000)]
    assert time.time() - start < 60


# Top products


@pytest.mark.parametrize("kind", ["lognormal", "unit", "cluster"])
def test_top_products(spark, monkeypatch, kind):
    monkeypatch.setattr(top_products, "BUCKET_ROWS", 150)
    monkeypatch.setattr(top_products, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    n = 900
    x = rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "lognormal":
        x *= rng.lognormal(0, 1, size=(n, 1))
    if kind == "cluster":
        x = x[rng.integers(0, 20, n)] + rng.normal(size=x.shape) * 0.05
        x[:300] = x[0]
    rows = [(i, [float(y) for y in r]) for i, r in enumerate(x)]
    rows += [(n, None), (n + 20, [None, 1.0]), (n + 40, [float("nan")] * 16), (n + 80, [float("inf")]), (None, [1.0]), (5, [99.0] * 16), (n + 60, []), (7, rows[7][1])]
    v = top_products.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = top_products.top_products(v, v.filter("vec_id % 20 = 0"), 20).collect()
    whole = np.vstack([np.floor(64 * x).astype(int), np.zeros((1, 16), int)])
    whole[5] = min(whole[5].tolist(), [64 * 99] * 16)
    ids = np.append(np.arange(n), n + 60)
    expected = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = whole @ whole[q]
        best = [j for j in np.lexsort((ids, -score)) if j != q][:20]
        expected += [(int(ids[q]), k + 1, int(ids[j]), int(score[j])) for k, j in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_top_products_sends_no_blocks_through_the_driver(spark):
    """What blocks become on their way to the buckets is no broadcast, small as the files of equal vectors are; numbers travel
    in as few bytes as hold them."""
    same = spark.range(3_000).selectExpr("id as vec_id", "array_repeat(cast(2 as bigint), 16) as v")
    got = top_products.top_products(same, same.filter("vec_id % 20 = 0"), 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan
    assert {(r["query_id"], r["vec_id"]) for r in got.collect()} == {(q, v) for q in range(0, 3_000, 20) for v in ([0, 1, 2] if q else [1, 2, 3])}
    for most, size in ((127, 1), (-128, 1), (128, 2), (-32_769, 4), (2**31, 8)):
        data = np.array([[0, most], [1, 2]])
        assert top_products._narrow(data).itemsize == size
        assert (top_products._matrix({"data": top_products._narrow(data).tobytes(), "ids": b"", "n": 2, "dim": 2}, 3)[1] == np.pad(data, ((0, 0), (0, 1)))).all()


def test_top_products_of_few(spark):
    few = top_products.integer_vectors(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [1.0])], "vec_id long, embedding array<double>"))
    assert read(top_products.top_products(few, few.filter("vec_id % 20 = 0"), 20).collect()) == read([(0, 1, 1, 8192), (0, 2, 20, 4096), (20, 1, 1, 8192), (20, 2, 0, 4096)])
    assert top_products.top_products(few.limit(0), few.limit(0), 20).count() == 0


# Benchmark leaks


def test_retrieval_is_all_above_the_threshold(spark, data):
    rng = random.Random(1)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/benchmark.parquet").collect()]
    index = benchmark_leaks.Index(items)
    for _ in range(100):
        words = benchmark_leaks.words(rng.choice(items)[1])
        rng.shuffle(words)
        terms = sorted({index.vocab[w] for w in words[: rng.randint(3, len(words))] + benchmark_leaks.words(rng.choice(items)[1])})
        score = collections.Counter()
        for t in terms:
            for i, x in zip(index.items[t], index.impacts[t]):
                score[i] += x
        assert sorted(i for i, s in score.items() if s >= index.threshold) == sorted(i for i, _ in index.retrieve(terms))


@pytest.mark.parametrize("shard", [20_000, 7])
def test_leaks(spark, data, monkeypatch, shard):
    monkeypatch.setattr(benchmark_leaks, "SHARD_ITEMS", shard)
    folder = data.replace("sf0.001", "sf0.01")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.lit(1).alias("Items"))
    item = benchmark.orderBy("item_id").first()
    half = " ".join(item["text"].split()[: len(item["text"].split()) // 2])
    extra = spark.createDataFrame([(None, None, 1), (-1, "", 1), (-2, half, 1), (-3, "X " * 100 + item["text"].upper() + " y" * 5000, 1), (-3, item["text"], 1)], docs.schema)
    docs = docs.unionByName(extra)
    items = {r["item_id"]: f" {' '.join(benchmark_leaks.words(r['text']))} " for r in benchmark.collect()}
    more = benchmark.unionByName(spark.createDataFrame([(None, "a b c"), (77, None), (78, "..."), (item["item_id"], item["text"])], benchmark.schema))
    found = benchmark_leaks.leaks(docs, more)
    expected = []
    for r in docs.collect():
        text = f" {' '.join(benchmark_leaks.words(r['text'] or ''))} "
        own = sorted(i for i, x in items.items() if x in text)
        expected.append((r["doc_id"], bool(own), len(own), own))
    assert read(found.drop("score").collect()) == read(expected)
    assert benchmark_leaks.without_leaks(docs, more).count() == sum(1 for x in expected if not x[1])
    assert benchmark_leaks.leaks(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert benchmark_leaks.leaks(docs.limit(0), benchmark).count() == 0


def test_leak_scores_do_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(6)
    part = lambda n: " ".join(rng.choice([f"c{rng.randrange(5)}", f"m{rng.randrange(40)}", f"r{rng.randrange(4000)}"]) for _ in range(n))
    items = [(i, f"first{i} {part(19)}. {part(20)}") for i in range(12)] + [(12, f"{part(150)}. {part(50)}")]
    items += [(3, f"other3 {part(19)}. {part(20)}")]
    cut = lambda text: text.split(" ", 1)[1]
    docs = [(i, cut(t)) for i, t in items[:13]] + [(20, f"{cut(items[1][1])} {'x ' * 40} first1"), (21, cut(items[3][1]) + " . " + items[-1][1])]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index, expected = benchmark_leaks.Index(sorted(items)), {}
    for d, t in docs:
        found = index.leaks(pa.array([t]))[0]
        expected[d] = (sorted(found), pytest.approx(max(found.values()), abs=1e-9))
    assert all(0.5 < s.expected < 1 for d, (_, s) in expected.items() if d < 12) and expected[20][1] == 1
    for most in (20_000, 5, 1):
        monkeypatch.setattr(benchmark_leaks, "SHARD_ITEMS", most)
        assert {r["doc_id"]: (r["items"], r["score"]) for r in benchmark_leaks.leaks(df, benchmark).collect()} == expected


def test_a_long_item_does_not_change_what_others_are_found_in(spark):
    """Question and answer 300 words apart are no leak of a short item, whether the benchmark has a long one or not."""
    rng = random.Random(9)
    part = lambda n: " ".join(f"r{rng.randrange(4000)}" for _ in range(n))
    short, long = [(i, f"{part(20)}. {part(12)}.") for i in range(6)], [(50, f"{part(6_000)}. {part(100)}.")]
    question, answer = short[2][1].split(". ")
    docs = [(0, short[1][1]), (1, f"{question} {'x ' * 300} {answer}"), (2, f"{'y ' * 500} {long[0][1]}"), (3, "nothing here"), (4, f"{'z ' * 63} {short[3][1]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for items, found in ((short, {0: [1], 1: [], 2: [], 3: [], 4: [3]}), (short + long, {0: [1], 1: [], 2: [50], 3: [], 4: [3]})):
        got = benchmark_leaks.leaks(df, spark.createDataFrame(items, "item_id long, text string"))
        assert {r["doc_id"]: r["items"] for r in got.collect()} == found


def test_steps_follow_from_the_item():
    assert [benchmark_leaks.step_of(n) for n in (0, 1, 64, 65, 128, 129, 256, 257)] == [64, 64, 64, 128, 128, 256, 256, 512]


# URL lists


def test_url_lists_on_edges(spark):
    day = 86_400
    captures = spark.createDataFrame(
        [
            (1, "http://User@Sub.Bad.example.org:80/x/y?q#f", 10 * day), (2, "https://bad.example.org", 50 * day), (3, "https://bad.example.org/x", 90 * day),
            (4, None, 10 * day), (5, "no host", 10 * day), (6, "//good.example.com/x/", None), (None, "http://bad.example.org/x/y/z", 10 * day),
            (7, "http://notbad.example.org", 10 * day), (1, "http://User@Sub.Bad.example.org:80/x/y?q#f", 10 * day), (8, "http://bad.example.org/x", 5 * day),
        ],
        "page_id long, url string, t long",
    ).withColumn("fetched_at", F.timestamp_seconds("t"))
    entries = spark.createDataFrame(
        [
            ("a", "bad.example.org", "spam", 5 * day, True), ("a", "bad.example.org", None, 40 * day, False), ("a", "bad.example.org", "late", 80 * day, None),
            ("b", "bad.example.org/x", "path", 8 * day, True), ("b", "bad.example.org/x", "path", 85 * day, False), ("b", "bad.example.org/x", "path", 85 * day, False),
            (None, "good.example.com", "x", 0, True), ("c", None, "x", 0, True), ("c", "good.example.com", "x", None, True),
        ],
        "list string, pattern string, category string, at long, active boolean",
    ).withColumn("listed_at", F.timestamp_seconds("at"))
    got = {r["id"]: (r["blocked"], r["n_matches"], r["list"], r["pattern"], r["category"]) for r in urls.filter_urls(captures, entries).collect()}
    assert got[1] == (True, 1, "a", "bad.example.org", "spam")
    assert got[2] == got[4] == got[5] == got[6] == got[7] == (False, 0, None, None, None)
    assert got[3] == (True, 1, "a", "bad.example.org", "late")
    assert got[None] == (True, 2, "b", "bad.example.org/x", "path")
    assert got[8] == (True, 1, "a", "bad.example.org", "spam")
    assert urls.filter_urls(captures, entries).count() == 9
    assert urls.filter_urls(captures, entries.limit(0)).filter("blocked").count() == 0
    assert urls.filter_urls(captures.limit(0), entries).count() == 0


def test_url_lists_of_any_depth(spark):
    deep = "/".join("abcdefghij")
    urls_ = [f"http://q.r.xyz/{deep}/k?x", f"http://q.r.xyz/{deep[:-2]}", "http://xyz", "http://r.wxyz/a", "http://t.u.v.w.other.net/a"]
    captures = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").withColumn("fetched_at", F.timestamp_seconds(F.lit(100)))
    patterns = ["xyz", f"q.r.xyz/{deep}", "u.v.w.other.net", "other.net"]
    entries = spark.createDataFrame([("a", p, "c", True) for p in patterns], "list string, pattern string, category string, active boolean").withColumn("listed_at", F.timestamp_seconds(F.lit(5)))
    got = {r["id"]: (r["blocked"], r["n_matches"], r["pattern"]) for r in urls.filter_urls(captures, entries).collect()}
    assert got == {0: (True, 2, f"q.r.xyz/{deep}"), 1: (True, 1, "xyz"), 2: (True, 1, "xyz"), 3: (False, 0, None), 4: (True, 2, "u.v.w.other.net")}
    only_paths = urls.filter_urls(captures, entries.filter("pattern like '%/%'"))
    assert [r["id"] for r in only_paths.filter("blocked").collect()] == [0]


def test_url_lists_keep_the_case_of_paths(spark):
    captures = spark.createDataFrame([(1, "http://HOST.org/Path/x"), (2, "http://host.org/path/x"), (3, "http://host.org/Path")], "page_id long, url string").withColumn("fetched_at", F.timestamp_seconds(F.lit(100)))
    entries = spark.createDataFrame([("a", "Host.ORG/Path/", "c", True)], "list string, pattern string, category string, active boolean").withColumn("listed_at", F.timestamp_seconds(F.lit(5)))
    got = {r["id"]: (r["blocked"], r["pattern"]) for r in urls.filter_urls(captures, entries).collect()}
    assert got == {1: (True, "host.org/Path"), 2: (False, None), 3: (True, "host.org/Path")}


# Registered queries


def tables(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return c


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in entry.queries() if n[2:3].isdigit() and n.startswith("op")}
    assert names == {f"op{k}" for k in range(1, 14)} and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op1", "op5", "op8"])
def test_queries_against_brute_force(spark, data, name):
    query = next(f for n, f in entry.queries().items() if n.startswith(f"{name}_"))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = query(spark, data)
    if name == "op1":
        assert read(got.collect()) == read(brute_classes(rows))
    elif name == "op5":
        assert read(got.collect()) == read(brute_repeated(rows))
    else:
        items = [f" {' '.join(benchmark_leaks.words(r['text']))} " for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
        leaked = {d for d, t in rows if any(i in f" {' '.join(benchmark_leaks.words(t))} " for i in items)}
        assert {r["doc_id"] for r in got.filter("contaminated").collect()} == leaked and got.count() == len(rows)
