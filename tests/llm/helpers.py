"""Small document tables with the cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, n=120, seed=1):
    """Documents with nulls, empty and blank texts, repeated rows, copies, near copies and a long text."""
    rng = random.Random(seed)
    words = ["the", "and", "of"] + ["".join(rng.choice("abcdeéfghiß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(k))
    texts = [say(rng.randint(1, 80)) for _ in range(n)]
    for i in range(0, n, 6):  # copies and near copies
        texts[i] = texts[(i + 6) % n]
        near = texts[i].split(" ")
        near[rng.randrange(len(near))] = "edited"
        texts[(i + 1) % n] = " ".join(near)
    texts[3:10] = [None, "", " \n\t ", "x", "One\x0btwo  three", "\U0001f600 日本 語", say(6000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "\U0001f600"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "no id at all", "en", "a", 12), (None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crowded(df):
    """df with more columns, some named like operators' own ones."""
    from pyspark.sql import functions as F

    names = ("SIZE", "score", "shard", "n_shingles", "fingerprint", "spans", "ids", "start", "kept", "law", "copies", "lm_score")
    return df.withColumns({n: F.lit("x") for n in names}).withColumn("mine", F.lit(7))
