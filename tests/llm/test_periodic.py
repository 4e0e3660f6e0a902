"""Runs against brute force, and the operator on odd rows."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from quarry.llm import periodic, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(t, least, exponent):
    found, n = set(), len(t)
    for p in range(1, n):
        x = 0
        while x < n - p:
            y = x
            while y < n - p and t[y] == t[y + p]:
                y += 1
            length = y - x + p
            if y > x and length >= max(least, exponent * p) and not any(all(t[i] == t[i + q] for i in range(x, y + p - q)) for q in range(1, p)):
                found.add((x, length, p))
            x = max(y, x + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(4000):
        n, letters = rng.randint(0, 26), rng.randint(1, 4)
        t = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.5:
            p = rng.randint(1, 6)
            t = [t[i % p] if rng.random() < 0.96 else t[i] for i in range(n)]
        for least, exponent in ((2, 2), (6, 4), (1, 3)):
            assert periodic.runs(t, least, exponent) == brute(t, least, exponent), (t, least, exponent)


def test_extensions_equal_brute_force():
    rng = random.Random(4)
    for _ in range(2000):
        n = rng.randint(1, 30)
        t = [rng.randrange(2) for _ in range(n)] + [-1]
        nss, right = periodic.next_smaller(t)
        left = periodic.left_extensions(t, nss)
        for low in range(n):
            r = next((j for j in range(low + 1, n) if t[j:] < t[low:]), n)
            assert nss[low] == r
            assert right[low] == (next(k for k in range(n) if t[low + k] != t[r + k]) if r < n else 0)
            assert left[low] == next((k for k in range(low) if t[low - 1 - k] != t[r - 1 - k]), low)


class Symbol(int):
    compared = 0

    def __lt__(self, other):
        Symbol.compared += 1
        return int(self) < int(other)

    def __eq__(self, other):
        Symbol.compared += 1
        return int(self) == int(other)

    __hash__ = None


def test_comparisons_are_linear():
    fib, longer = [0], [0, 1]
    while len(longer) < 4000:
        fib, longer = longer, longer + fib
    for t in (longer, [0] * 4000, [i % 7 for i in range(4000)], [(i % 40 == 0) * 1 for i in range(4000)]):
        Symbol.compared = 0
        u = [Symbol(x) for x in [*t, -1]]
        periodic.left_extensions(u, periodic.next_smaller(u)[0])
        assert Symbol.compared < 10 * len(t)


def test_operator_on_odd_rows(spark):
    rows = [
        (1, "a b a b a b a b a b", "x"), (2, None, None), (3, "", "y"), (4, " \n\t ", "z"), (None, "go go go go go go stop", "n"), (5, "a b a b a b a b a b", "x"),
        (6, "longerthan7 longerthan8 " * 6 + "longerthan7", "l"), (7, "a\x00 a a\x00 a a\x00 a a\x00 a", "0"), (8, "é x " * 7, "u"), (9, "w " * 60_000, "very long"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string").withColumn("collapsed", F.lit(1))
    got = periodic.find_runs(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "n_words", "runs", "collapsed"}
    by = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got}
    assert by[1] == by[5] == ([(0, 10, 2)], "a b")
    assert by[2] == by[3] == by[4] == ([], "")
    assert by[None] == ([(0, 6, 1)], "go stop")
    assert by[6] == ([(0, 13, 2)], "longerthan7 longerthan8")
    assert by[7] == ([(0, 8, 2)], "a\x00 a")
    assert by[8] == ([(0, 7, 1)], "é x")
    assert by[9] == ([(0, 60_000, 1)], "w")
    assert periodic.find_runs(docs.where("false")).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", "  "])) for i in range(300)] + [(300, None), (None, "a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for key, text in rows:
        w = WORD.findall((text or "").encode())
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        found = brute(w, 6, 4)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        r = got[key]
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
