"""Operators on whole tables against brute force: near-duplicates, sharding, mixing, search, and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import components, mixing, neardup, sharding, topk
from tests.llm.helpers import SCHEMA, corpus, crowded, empty

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, width, percent=80):
    """doc_id -> (size of its set, smallest doc_id reachable)."""
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(top(x), top(y))] = min(top(x), top(y))
    return {i: (len(sets[i]), top(i)) for i in ids}


def check_near(spark, rows, docs, width):
    want = brute_components({(r[0], r[1]) for r in rows if r[0] is not None}, width)
    got = neardup.near_duplicates(docs.select("doc_id", "text").where("doc_id is not null"), width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return want


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rows, docs = corpus(spark)
    want = check_near(spark, rows, docs, width)
    assert sum(v[1] != i for i, v in want.items()) > 10
    wide = neardup.near_duplicates(crowded(docs), width).collect()
    assert len(wide) == len(rows) and wide[0].mine == 7 and "shard" in wide[0].asDict()
    for r in wide:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert neardup.near_duplicates(empty(spark), width).count() == 0
    assert neardup.near_duplicates(docs.where("doc_id in (3, 4, 5)").select("doc_id", "text"), width).where("kept").count() == 3


def test_near_duplicates_in_groups(spark):
    """Groups around a text, chains of edits, and texts that share a long passage without being similar."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    draw = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    texts, base, passage = [], draw(100), draw(60)
    for k in range(90):  # copies with 2 to 12 edits: some are similar to the base and not to each other
        copy = list(base)
        for _ in range(2 + k % 11):
            copy[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append(copy)
    texts.append(base)
    chain = draw(60)
    for _ in range(15):
        chain = list(chain)
        for _ in range(3):
            chain[rng.randrange(60)] = rng.choice(vocabulary)
        texts.append(chain)
    texts += [passage + draw(60) for _ in range(40)] + [passage + draw(8) for _ in range(20)] + [["a", "b", "c", "d"][: 1 + k % 4] for k in range(8)]
    rng.shuffle(texts)
    rows = [(i * 3, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    want = check_near(spark, rows, spark.createDataFrame(rows, SCHEMA), 2)
    assert max(Counter(c for _, c in want.values()).values()) > 30


def test_signature_guarantee():
    """Signatures within the limit share a key; the join has no other condition."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (50, neardup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(neardup.SYMBOLS, neardup.LIMIT, replace=False)
        row[at] ^= 1
    batch = lambda s: pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([1] * 50, pa.int64()), pa.array([r.tobytes() for r in s], pa.binary())], names=["rep", "n", "symbols"])
    keys = [next(neardup._keys(iter([batch(s)]))) for s in (a, b)]
    found = [defaultdict(set), defaultdict(set)]
    for f, k in zip(found, keys, strict=True):
        for key, rep in zip(k.column(0).to_pylist(), k.column(1).to_pylist(), strict=True):
            f[rep].add(key)
    assert all(found[0][i] & found[1][i] for i in range(50))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 9), (9, 7), (9, 8)] + [(1000, 1000 + k) for k in range(1, 50)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, 8: 7, 9: 7, **{1000 + k: 1000 for k in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_shards(got, rows, shards):
    import zlib

    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(loads.values()) == sum(len((t or "").encode()) + 16 for _, t, *_ in rows)
    return loads


def test_shards(spark):
    rows, docs = corpus(spark)
    check_shards(sharding.shard_documents(crowded(docs), 4).collect(), rows, 4)
    assert sharding.shard_documents(docs, 4).columns == ["doc_id", "lang", "source", "n_chars", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sharding.shard_documents(empty(spark), 4).count() == 0
    one = sharding.shard_documents(docs.where("doc_id = 12"), 40).collect()
    assert len(one) == 1 and one[0].slot == 0
    with pytest.raises(ValueError, match="shards"):
        sharding.shard_documents(docs, 0)


def test_shards_hold_groups_and_sizes(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randint(20, 400)))) for i in range(1500)]
    rows += [(2000 + i, f"copied text {i % 60}" * 8) for i in range(240)] + [(5000 + i, "hot " * 30) for i in range(900)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    loads = check_shards(got, rows, 8)
    assert max(loads.values()) - min(loads.values()) < 400
    where = defaultdict(Counter)
    for r in got:
        where[dict(rows)[r.doc_id]][r.shard] += 1
    cut = sum(len(where[f"copied text {k}" * 8]) - 1 for k in range(60))
    assert cut < 12  # of 180 that chance would cut for the most part
    assert len(where["hot " * 30]) > 2  # a hot group is no shard's alone
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_mixing(spark):
    rng = random.Random(8)
    sources = ["a", "b", "c", None, "\U0001f600", "￮"]
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(sources[: 1 + i % 6])) for i in range(3000)] + [(9000, None, "a"), (9001, " ", "z"), (9002, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.pareto_mix(crowded(docs)).collect()
    assert len(got) == len(rows) and got[0].mine == 7
    by = defaultdict(lambda: [0, 0, None, None])
    for r in got:
        assert r.size == len(SPLIT.findall(dict((i, t or "") for i, t, _ in rows)[r.doc_id])) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        b = by[r.source]
        b[0], b[1], b[2], b[3] = b[0] + r.size, b[1] + r.taken, r.source_size, r.target
    # targets by sharing again and again
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, want = 1.5 * sum(b[0] for b in by.values()), set(order), {}
    while True:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 2 * by[s][0]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * by[s][0]
            left -= want[s]
        open_ -= over
    want |= {s: rate * weight[s] for s in open_}
    for s, b in by.items():
        assert b[2] == b[0] and b[3] == pytest.approx(want[s]) and abs(b[1] - b[3]) <= 31
    assert {(r.doc_id, r.taken) for r in mixing.pareto_mix(docs).collect()} == {(r.doc_id, r.taken) for r in got}
    assert mixing.pareto_mix(empty(spark)).count() == 0
    repeated = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, None, None)], "doc_id long, text string, source string")
    assert mixing.pareto_mix(repeated).count() == 51
    assert mixing.pareto_mix(docs.where("doc_id = 9000")).first().taken == 0


def brute_mix(rows, targets, seed, power=0.5, most=2.0):
    """Copies and expected copies of each (doc_id, text, source), by Pareto sampling of all of a source's documents at once."""
    out = {}
    for source, target in targets.items():
        own = [(i, t, len(SPLIT.findall(t or ""))) for i, t, s in rows if s == source]
        weight = {i: 2.0 ** (math.floor(math.log2(max(1, n)) * 4) / 4 * power) for i, _, n in own}
        full, rate = set(), 0.0
        while True:  # more and more documents are held at `most`
            open_ = sum(n * weight[i] for i, _, n in own if i not in full)
            rate = (target - sum(most * n for i, _, n in own if i in full)) / open_ if open_ else 0.0
            over = {i for i, _, _ in own if i not in full and rate * weight[i] > most}
            if not over:
                break
            full |= over
        expected = {i: most if i in full else rate * weight[i] for i, _, _ in own}
        whole = {i: min(int(most), math.floor(x + 1e-12)) for i, x in expected.items()}
        left, ranked = target - sum(whole[i] * n for i, _, n in own), []
        for i, t, n in own:
            p = expected[i] - whole[i]
            h = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)
            h = xxhash.xxh64_intdigest(t.encode(), h) if t is not None else h
            h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h)
            u = ((h >> 11) + 0.5) / 2**53
            if n and p > 0:
                ranked.append((u / (1 - u) * (1 - p) / p, h, i, n))
        for _, _, i, n in sorted(ranked):
            if n / 2 <= left:
                whole[i] += 1
            left -= n
        out |= {i: (whole[i], expected[i]) for i, _, _ in own}
    return out


def test_mixing_equals_brute_force(spark):
    rng = random.Random(18)
    rows = [(i, " ".join("w" * (rng.randint(1, 9) if i % 3 else rng.randint(50, 400))), "abc"[min(i % 7, 2)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2):
        got = mixing.pareto_mix(docs, seed=seed).collect()
        targets = {r.source: r.target for r in got}
        want = brute_mix(rows, targets, seed)
        assert {r.doc_id: r.copies for r in got} == {i: c for i, (c, _) in want.items()}
        assert all(r.inclusion == pytest.approx(want[r.doc_id][1]) for r in got)
        assert len({round(r.inclusion, 6) for r in got if r.source == "c"}) > 5  # odds differ within a source


def test_mixing_takes_documents_as_often_as_expected():
    rng = random.Random(19)
    rows = [(i, " ".join("w" * rng.choice([1, 3, 10, 30, 100])), "a") for i in range(400)]
    words = sum(len(t.split()) for _, t, _ in rows)
    drawn, times = Counter(), 300
    for seed in range(times):
        found = brute_mix(rows, {"a": 0.8 * words}, seed)
        drawn.update({i: c for i, (c, _) in found.items()})
    for size in (1, 3, 10, 30, 100):  # by class, as all documents of a size have the same odds
        own = [i for i, t, _ in rows if len(t.split()) == size]
        expected = found[own[0]][1]
        assert sum(drawn[i] for i in own) / times / len(own) == pytest.approx(expected, abs=0.03)


def brute_topk(rows, k, every):
    sound = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in sound if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [7, 10_000])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", block)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(6) / 3)]) for i in range(150)]
    rows[10:20] = [(i, rows[10][1]) for i in range(10, 20)]  # ties
    rows[30:36] = [(30, None), (31, [1.0] * 5 + [None]), (32, [float("nan")] * 6), (33, [float("inf")] + [0.0] * 5), (34, [0.0] * 6), (None, [1.0] * 6)]
    rows += [(400, [1.0, 2.0]), (401, [0.5, -0.5]), (500, []), (601, [1e30] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.topk(crowded(df.withColumn("text", F.lit("x"))), F.col("vec_id") % 20 == 0, 5)
    held = {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()}
    want = brute_topk([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 20)
    assert held == {(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in want}
    assert topk.topk(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_algorithm_stops():
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.integers(-5, 6, (4000, 8)), np.full((30, 8), 60)]).astype(np.int64)
    queries = np.ones((1, 8), np.int64)
    (plain,), scored = topk.threshold_topk(np.arange(4030), rows, np.array([-1]), queries, 20)
    assert plain[0].tolist() == list(range(4000, 4020)) and set(plain[1].tolist()) == {480.0} and scored[0] < 400
    (one,), _ = topk.threshold_topk(np.arange(4030), rows, np.array([4000]), queries, 20)
    assert one[0].tolist() == list(range(4001, 4021))
    # with a floor that no row reaches, nothing is read; with one that some reach, those are found
    (nothing,), scored = topk.threshold_topk(np.arange(4000), rows[:4000], np.array([-1]), queries, 20, np.array([41]))
    assert len(nothing[0]) == 0 and scored[0] == 0
    (some,), _ = topk.threshold_topk(np.arange(4030), rows, np.array([-1]), queries, 20, np.array([480]))
    assert some[0].tolist() == list(range(4000, 4020))


def test_threshold_algorithm_against_all_scores():
    rng = np.random.default_rng(9)
    for case in range(40):
        n, d = int(rng.integers(1, 900)), int(rng.integers(1, 30))
        sparse = case % 2 == 0  # few components that count: the walks stop early
        rows = rng.integers(-60, 61, (n, d)) * (rng.random((n, d)) < (0.1 if sparse else 1.0))
        queries = rng.integers(-60, 61, (5, d)) * (rng.random((5, d)) < (0.3 if sparse else 1.0))
        ids = rng.permutation(n)
        found, scored = topk.threshold_topk(ids, rows, np.arange(5), queries, 7)
        for q in range(5):
            s = rows @ queries[q]
            want = sorted((-s[i], ids[i]) for i in range(n) if ids[i] != q)[:7]
            assert [(-x, i) for i, x in zip(*found[q], strict=True)] == want and scored[q] <= n


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = ["calm", "clear", "field", "river", "stone", "light"] + [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(240):
        ok = rng.random() < 0.8
        text = " ".join(rng.choice(words) if ok else rng.choice(["$$$", "###", "buy!!", "the"]) for _ in range(rng.randint(12, 40)))
        rows.append([i, text, "en", rng.choice("ab"), len(text)])
        labels.append((i, int(ok), 0))
    rows[1][1] = rows[0][1] = "river stone light calm field river clear stone light calm and more of it"
    labels[0], labels[1] = (0, 1, 0), (1, 1, 0)
    rows[2][1] += " jo@mail.example.com"
    rows[3][1] = None
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    one = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    kept = {r.doc_id for r in one.collect()}
    truth = {i for i, y, _ in labels if y}
    assert one.columns == docs.columns and len(kept ^ truth) < 12
    two = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    want = brute_components({(r[0], r[1]) for r in rows}, 5)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {i for i, (_, c) in want.items() if i == c}
    three = corpus_pipeline.redact_personal_data(spark, docs, str(tmp_path))
    by = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and by[2].text.endswith(" [EMAIL]") and by[2].n_chars == len(by[2].text) and by[3].text is None and by[5].text == rows[5][1]
    four = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    copies = {r.doc_id: r.copies for r in mixing.pareto_mix(docs).collect()}
    assert four.columns == docs.columns and Counter(r.doc_id for r in four.collect()) == Counter({i: c for i, c in copies.items() if c})
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} <= kept - {1} and all(r.n_tokens == len(r.ids) for r in last) and len(corpus_pipeline.STAGES) == 5


def test_pipeline_decodes_every_document(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    _, docs = corpus(spark)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, texts = corpus_pipeline.encode_tokens(spark, docs, str(tmp_path)).collect(), Counter(r.text or "" for r in docs.collect())
    want = Counter()
    for t, n in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    assert Counter((tuple(r.ids), r.decoded_sha256) for r in got) == want


def test_pipeline_drops_near_duplicates_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    say = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    a, b, c, d = say(), say(), say(), say()
    rows = [(1, a), (1, a), (1, a), (2, a + " end"), (2, b), (3, c), (3, c + " end"), (4, d), (None, a), (None, a), (5, None), (5, None), (6, " ")]
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], SCHEMA).repartition(4)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    three = next(t for i, t in got if i == 3)
    assert three in (c, c + " end") and got == Counter([(1, a), (2, b), (3, three), (4, d), (None, a), (None, a), (5, None), (5, None), (6, " ")])


def test_threshold_algorithm_with_repeated_query_rows():
    rng = np.random.default_rng(5)
    for copies in (2, 30, 300):
        rows = np.concatenate([rng.integers(-9, 10, (400, 6)), np.full((copies, 6), 40)]).astype(np.int64)
        ids = np.concatenate([np.arange(400), np.full(copies, 1000)])
        (got,), _ = topk.threshold_topk(ids, rows, np.array([1000]), rows[-1:], 20)
        scores = rows[:400] @ rows[-1]
        best = np.lexsort((np.arange(400), -scores))[:20]
        assert got[0].tolist() == best.tolist() and got[1].tolist() == scores[best].tolist()
