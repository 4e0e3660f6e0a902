"""Search terms by the automaton against the patterns, line by line."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.classify import identifier_match, word_match
from quarry.functions.text import lines
from quarry.operators.terms import TermMatcher, term_tallies, with_term_hits
from quarry.plans.scan import term_rows

TERMS = ["Flag", "flag", "a", "C#", ".NET", "->", "my_flag", "a b", "x.y", "(?", "Straße", "日本", "é", "3", "", "two\nlines", "b", "ab", "Flag", "É"]
PIECES = ["Flag", "flag", "FLAG", "myflag", "my_flag", "My_Flag", "a", "b", "ab", " ", " ", ".", "C#", "c#x", "x.NET ", ".net", "a->b", "->", "x.y", "\n", "\r\n", "\r", "///", " /// ", "// ", "(?", "é", "É", "é", "Straße", "STRASSE", "日本語", "日本", "İ", "3", "2", "‍", "\t", "_", "²", "٣"]


def brute(spark, texts, terms):
    """(path, term) -> words, docs, names, first line, from the patterns of `functions.classify`, one by one."""
    rows = spark.createDataFrame(list(enumerate(texts)), "path int, content string").select("path", F.posexplode(lines(F.col("content"))).alias("n", "line"))
    out = {}
    for term in dict.fromkeys(terms):
        if not term:
            continue
        t = F.lit(term)
        doc, w = F.ltrim("line").startswith("///"), word_match(F.col("line"), t)
        found = rows.groupBy("path").agg(
            F.count_if(w).alias("w"), F.count_if(w & doc).alias("d"), F.count_if(F.col("line").contains(term) & identifier_match(F.col("line"), t)).alias("i"),
            F.min(F.when(F.col("line").contains(term), F.col("n") + 1)).alias("f"),
        )
        out |= {(r["path"], term): (r["w"], r["d"], r["i"], r["f"] or 1) for r in found.collect() if r["w"] or r["i"]}
    return out


def test_hits_equal_patterns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", None, "\n\n", "Flag"]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, content string")
    got = {(r["path"], r["term"]): (r["words"], r["docs"], r["names"], r["first_line"]) for r in with_term_hits(df, TERMS).select("path", F.inline("hits")).collect()}
    want = brute(spark, [t or "" for t in texts], [t for t in TERMS if "\n" not in t])
    assert {k: got.get(k) for k in want} == want and set(got) == set(want)


def test_tallies_by_kind(spark):
    df = spark.createDataFrame([("p", "/// Flag flag\n Flag\nflags\n", 7), ("q", None, 8)], "path string, content string, more int")
    got = {(r["match_kind"], r["hit_count"], r["first_line"], r["more"]) for r in term_tallies(df, ["Flag", "none"], keep=["more"]).collect()}
    assert got == {("string_literal", 2, 1, 7), ("comment", 1, 1, 7), ("xml_doc", 1, 1, 7), ("identifier", 2, 1, 7)}
    assert term_tallies(df, []).count() == 0 and term_tallies(df.where("false"), ["Flag"]).count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_thousand_terms_in_one_plan(spark):
    files = spark.range(4).select(F.concat(F.lit("f"), "id", F.lit(".cs")).alias("path"), F.lit("term7 x\nterm999").alias("content"), F.lit("production").alias("kind"))
    few, many = ["term7"], [f"term{i}" for i in range(1000)]
    assert len(plan(term_rows(files, many))) - len(plan(term_rows(files, few))) < 200
    assert "Join" not in plan(term_rows(files, many)) and plan(term_rows(files, many)).count("MapInArrow") == 1
    rows = term_rows(files, many).orderBy("path", "ordinal").collect()
    assert len(rows) == 4 * 2 * 3 and {r["symbol_name"] for r in rows} == {"term7", "term999"}
    assert [r["line_start"] for r in rows if r["symbol_name"] == "term999"] == [2] * 12


def test_long_text_and_many_terms():
    matcher = TermMatcher([f"w{i}" for i in range(5000)])
    text = "\n".join(f"w{i % 700} w{i % 11}x" for i in range(100_000))
    hits = matcher.hits(text)
    assert len(hits) == 700 and hits[699]["words"] == 142 and hits[699]["first_line"] == 700


@pytest.mark.parametrize("text", ["ﬁ Flag", "İİ Flag flag", "Flaǵ Flag"])
def test_places_stay_when_case_changes_length(text):
    assert TermMatcher(["Flag"]).hits(text)[0]["names"] == 1


def test_hits_are_held_for_few_texts_at_once():
    """A batch of a large table has 10,000 rows; its hits come in slices, all rows in order."""
    import pyarrow as pa

    from quarry.operators.terms import hit_batches

    batch = pa.RecordBatch.from_pydict({"n": list(range(1_000)), "content": [f"a{i % 3} x" if i % 7 else None for i in range(1_000)]})
    made = list(hit_batches(iter([batch, batch.slice(0, 0)]), ["a1"], 1))
    assert max(b.num_rows for b in made) <= 256 and [n for b in made for n in b["n"].to_pylist()] == list(range(1_000))
    assert [len(h) for b in made for h in b["hits"].to_pylist()] == [int(i % 3 == 1 and i % 7 > 0) for i in range(1_000)]
