"""Document fingerprints by a homomorphic multiset hash. DataFrame functions only.

A text is the multiset of its paragraphs, the parts between line feeds (so an empty text is one empty paragraph). Each
paragraph is hashed to a wide vector, and the text's fingerprint is the sum of its paragraphs' vectors, lane by lane
modulo 2**32. Nothing else of a text enters it: texts with the same paragraphs in any order have equal fingerprints, and
`added` and `removed` insert or delete paragraphs without the rest of the text. fp(x + "\\n" + y) = fp(x) + fp(y) for
all texts x and y.

A paragraph's vector has two parts, side by side:

* EQUAL lanes are the eight 32-bit words of the paragraph's SHA-256. Texts whose multisets differ have different sums
  but by chance; lanes this few are no defence against texts that are made to collide.
* LIKE lanes are sums of signs: each short piece of the paragraph is hashed to one sign a lane. Pieces end at white space
  after a character that is not in n-z, 5-9 or a comma, so an insertion moves no later piece. They make fingerprints
  comparable: a lane, read as a signed number, is a random projection of the multiset of pieces, so the cosine of two
  fingerprints' LIKE lanes estimates the cosine of the multisets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import cut, others, small_side

EQUAL, LIKE = 8, 96
#: A lane's size, and its hexadecimal digits in a fingerprint.
MODULUS, DIGITS = 1 << 32, 8
PIECE = r"(?<=[^n-zN-Z5-9,\s])\s+"
OUT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

#: Two lanes to a long: bits j and j + 32 of a hash.
PAIR = 1 | 1 << 32
#: Documents in a range of ids, and most ranges.
RANGE_ROWS, RANGES = 256, 65536


def paragraphs(text: Column) -> Column:
    """The parts between line feeds, one at least; null is empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def pieces(text: Column) -> Column:
    """The pieces of all paragraphs; each comes from one paragraph alone."""
    return F.flatten(F.transform(paragraphs(text), lambda p: F.filter(F.split(p, PIECE), lambda x: x != "")))


def equal_lanes(text: Column) -> Column:
    """array<long> of EQUAL sums over the paragraphs' SHA-256, modulo MODULUS."""
    words = lambda p: F.transform(F.sequence(F.lit(0), F.lit(EQUAL - 1)), lambda i: F.conv(F.substring(p, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("long"))
    vectors = F.transform(paragraphs(text), lambda p: words(F.sha2(p.cast("binary"), 256)))
    zero = F.array(*[F.lit(0).cast("long")] * EQUAL)
    return F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: (x + y) % MODULUS))


def like_sums(a: Column, b: Column) -> list[Column]:
    """Aggregates over the hashes a and b of pieces: LIKE / 2 longs, each of two counts of signs that are positive."""
    shifts = [(a, j) for j in range(32)] + [(b, j) for j in range(LIKE // 2 - 32)]
    return [F.coalesce(F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(PAIR))), F.lit(0)) for h, j in shifts]


def like_lanes(n: Column, packed: Column) -> Column:
    """array<long> of LIKE sums of signs, modulo MODULUS, from n pieces' counts: of n signs, k positive ones sum to 2 * k - n."""
    halves = F.transform(packed, lambda v: F.array(v.bitwiseAND(F.lit(MODULUS - 1)), F.shiftrightunsigned(v, 32)))
    return F.transform(F.flatten(halves), lambda k: F.pmod(k * 2 - n, F.lit(MODULUS)))


def rendered(lanes: Column) -> Column:
    """Lanes as text: base64 of all of them, 32 bits each, the first byte highest."""
    text = F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), DIGITS, "0")), "")
    return F.translate(F.base64(F.unhex(text)), "\r\n", "")


def lanes(fingerprint: Column) -> Column:
    """array<long> of a fingerprint's lanes."""
    text = F.hex(F.unbase64(fingerprint))
    return F.transform(F.sequence(F.lit(0), F.lit(EQUAL + LIKE - 1)), lambda i: F.conv(F.substring(text, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("long"))


def added(fingerprint: Column, more: Column) -> Column:
    """The fingerprint of a text to which the paragraphs of the text with the fingerprint `more` are added."""
    return rendered(F.zip_with(lanes(fingerprint), lanes(more), lambda x, y: (x + y) % MODULUS))


def removed(fingerprint: Column, less: Column) -> Column:
    """The fingerprint of a text from which the paragraphs of the text with the fingerprint `less` are taken."""
    return rendered(F.zip_with(lanes(fingerprint), lanes(less), lambda x, y: F.pmod(x - y, F.lit(MODULUS))))


def likeness(x: Column, y: Column) -> Column:
    """Cosine of two fingerprints' LIKE lanes, given as lanes (array<long>), held to 0..1. Equal fingerprints: 1."""

    def signed(v: Column) -> Column:
        own = F.slice(v, EQUAL + 1, LIKE)
        return F.transform(own, lambda k: (k - F.when(k >= MODULUS // 2, F.lit(MODULUS)).otherwise(F.lit(0))).cast("double"))

    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)
    a, b = signed(x), signed(y)
    cosine = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    return F.when(x == y, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def _ranges(docs: DataFrame) -> tuple[Column, int]:
    """The range of a row's doc_id, counted from the largest ids, and the number of ranges; the bounds are quantiles."""
    n = docs.count()
    wide = max(1, math.isqrt(min(RANGES, n // RANGE_ROWS)))
    if wide == 1:
        return F.lit(0), 1
    shares = [i / (wide * wide) for i in range(1, wide * wide)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10 * wide * wide).alias("b")).first()["b"] or []  # RANGES at most
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0), 1
    chunks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    firsts = F.array(*[F.lit(c[0]).cast("long") for c in chunks])
    nested = F.array(*[F.array(*[F.lit(b).cast("long") for b in c]) for c in chunks])
    chunk = F.size(F.filter(firsts, lambda b: b < F.col("doc_id")))
    below = F.when(chunk == 0, F.lit(0)).otherwise((chunk - 1) * wide + F.size(F.filter(F.element_at(nested, F.greatest(chunk, F.lit(1))), lambda b: b < F.col("doc_id"))))
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - below), len(bounds) + 2


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with n_chars, the SHA-256 of the edited text, both fingerprints and two likenesses.

    The edited text: the last floor(n_chars / 3) code points are replaced by the first as many (or all) of the
    next document, in descending doc_id; after the last comes the first. Null texts count as empty. Null ids come last;
    rows of the same id are ordered by a hash of their text, and equal rows have equal results. A table of one row is next
    to itself, an empty one gives no rows. Very long texts are read whole. Other columns pass through, but for those named
    like the results (in any case). Likenesses are those of the fingerprints that are returned.

    Texts are shuffled once, by ranges of doc_id; the first document of each range is also dealt to the range
    before, so that what follows a document is always found in its own partition.
    """
    kept = [c for c in others(docs, OUT) if c not in ("text", "doc_id")]
    of_range, _ = _ranges(docs)
    held = F.struct(*[F.col(c) for c in kept]) if kept else F.lit(None).cast("int")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("__kept"), of_range.cast("int").alias("__range"))
    base = base.withColumn("__h", F.xxhash64("text")).withColumn("__head", F.lit(0))
    order = [F.col("doc_id").desc_nulls_last(), F.col("__h").desc()]
    # a range's first row: largest id, and of equal ids the largest hash
    tops = cut(base.groupBy("__range").agg(F.max(F.struct(F.col("doc_id"), F.col("__h"))).alias("t")).select("__range", "t.*"))
    found = [r[0] for r in tops.select("__range").orderBy("__range").collect()]  # RANGES at most
    if found:
        before = dict(zip(found, [found[-1], *found[:-1]], strict=True))
        pairs = docs.sparkSession.createDataFrame(list(before.items()), "r int, p int")
        tops = tops.join(F.broadcast(pairs), tops["__range"] == F.col("r"))  # RANGES pairs of integers at most
        match = base.select(F.col("doc_id").alias("i"), F.col("__h").alias("g"), "text").join(small_side(cut(tops.select("doc_id", "__h", "p"))), F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("__h")))
        heads = match.groupBy("p").agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"), F.first("__h").alias("__h"))
        heads = heads.select("doc_id", "text", F.lit(None).cast(base.schema["__kept"].dataType).alias("__kept"), F.col("p").alias("__range"), "__h", F.lit(1).alias("__head"))
        base = base.unionByName(heads)
    w = Window.partitionBy("__range").orderBy("__head", *order)
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - tail).cast("int")), F.substring(F.lead("text").over(w), F.lit(1), tail))
    placed = base.withColumn("__i", F.row_number().over(w)).withColumn("__edited", F.coalesce(edited, F.col("text")))
    both = placed.select(
        "__range", "__head", "__i", "doc_id", "__kept", n.cast("long").alias("n_chars"), F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("__edited").alias("t")))).alias("v"),
    )
    keys = ["__range", "__head", "__i", "__which"]
    facts = ["doc_id", "__kept", "n_chars", "edited_sha256", "__equal"]
    hashed = both.select("__range", "__head", "__i", F.col("v.which").alias("__which"), "doc_id", "__kept", "n_chars", "edited_sha256", equal_lanes(F.col("v.t")).alias("__equal"), pieces(F.col("v.t")).alias("__p"))
    rows = hashed.select(*keys, *facts, F.explode_outer("__p").alias("p"))
    rows = rows.select(*keys, *facts, F.when(F.col("p").isNotNull(), F.xxhash64("p")).alias("a"), F.when(F.col("p").isNotNull(), F.xxhash64("p", F.lit(1))).alias("b"))
    sums = like_sums(F.col("a"), F.col("b"))
    summed = rows.groupBy(*keys, *facts).agg(F.count("a").alias("__n"), *[s.alias(f"l{i}") for i, s in enumerate(sums)])
    packed = summed.select(*keys, *facts, F.concat("__equal", like_lanes(F.col("__n"), F.array(*[f"l{i}" for i in range(len(sums))]))).alias("__v"))
    along = Window.partitionBy("__range").orderBy("__head", "__i", "__which")
    joined = packed.withColumn("__e", F.lead("__v", 1).over(along)).withColumn("__x", F.lead("__v", 2).over(along)).where("__head = 0 and __which = 0")
    return joined.select(
        "doc_id", *[F.col(f"__kept.`{c}`").alias(c) for c in kept], "n_chars", "edited_sha256",
        rendered(F.col("__v")).alias("fingerprint"), rendered(F.col("__e")).alias("edited_fingerprint"),
        likeness(F.col("__v"), F.col("__e")).alias("near_edited"), likeness(F.col("__v"), F.col("__x")).alias("near_next"),
    )
