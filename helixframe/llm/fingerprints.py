"""Operator 3: document fingerprints by one-permutation MinHash, in Spark expressions only.

Words are what stands between ASCII white space; shingles are ``SHINGLE`` consecutive words (all of them where a text
has fewer). Each shingle is hashed once. The hash's upper half picks one of ``BINS`` bins, whose least hash is kept.
An empty bin i borrows from the first filled bin among (a_i * t + b_i) mod BINS, t = 0, 1, ... (optimal
densification; BINS is prime and a_i, b_i are fixed draws, so the probes of two bins are independent and cover all
bins). The four low bits of each bin's value are packed as one hexadecimal digit. Two fingerprints agree in a share
m of the digits; chance agreement is taken out: likeness = (m - 1/16) / (1 - 1/16), not below 0.

Defined results: a text without words, null included, has the empty fingerprint, which is like only another empty
one (1, else 0); equal texts have equal fingerprints; rows with equal ids follow each other in order of their
texts; a single row is its own next.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import let

BINS = 257
SHINGLE = 5
BITS = 4
_PROBES = 6
_draw = random.Random(20240229)
_A = [_draw.randrange(1, BINS) for _ in range(BINS)]
_B = [_draw.randrange(BINS) for _ in range(BINS)]
_A_INVERSE = [pow(a, -1, BINS) for a in _A]


def words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingle_hashes(text: Column) -> Column:
    """array<bigint>, one hash for each place of a shingle."""

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= SHINGLE, F.array(F.xxhash64(w))).otherwise(
            F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        )

    return let(words(text), of)


def _bin(h: Column) -> Column:
    return F.shiftright((F.shiftright(h, 32) + F.lit(1 << 31)) * F.lit(BINS), 32)


def _literals(values) -> Column:
    return F.lit([int(v) for v in values])


#: The largest hash of each bin: a sentinel that stands in an empty bin.
_TOPS = [((((i + 1) << 32) - 1) // BINS - (1 << 31)) << 32 | 0xFFFFFFFF for i in range(BINS)]


def fingerprint(text: Column) -> Column:
    """The packed digits of a text, BINS of them or none."""

    def densify(least: Column) -> Column:
        # least: the smallest hash or sentinel of each bin, in the order of the bins
        filled = F.transform(F.arrays_zip(least.alias("h"), _literals(_TOPS).alias("top")), lambda x: F.when(x["h"] < x["top"], x["h"]))

        def fill(bins: Column) -> Column:
            def borrowed(i: Column) -> Column:
                a, b, inverse = (F.get(_literals(v), i) for v in (_A, _B, _A_INVERSE))
                tries = [F.get(bins, ((a * t + b) % BINS).cast("int")) for t in range(_PROBES)]
                turn = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.when(F.get(bins, j).isNotNull(), F.struct(F.pmod((j - b) * inverse, F.lit(BINS)).alias("t"), F.get(bins, j).alias("h"))))
                return F.coalesce(F.get(bins, i), *tries, F.array_min(turn)["h"])

            digit = lambda i: F.substring(F.lit("0123456789abcdef"), borrowed(i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1, F.lit(1))
            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), digit), "")

        return let(filled, fill)

    def of(hashes: Column) -> Column:
        def firsts(ordered: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(ordered, F.lit(1), F.size(ordered) - 1))
            pairs = F.arrays_zip(ordered.alias("h"), before.alias("p"))
            return F.transform(F.filter(pairs, lambda x: x["p"].isNull() | (_bin(x["h"]) != _bin(x["p"]))), lambda x: x["h"])

        packed = let(let(F.sort_array(F.concat(hashes, _literals(_TOPS))), firsts), densify)
        return F.when(F.size(hashes) == 0, F.lit("")).otherwise(packed)

    return let(shingle_hashes(text), of)


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two fingerprints."""
    same = F.size(F.filter(F.zip_with(F.split(one, ""), F.split(other, ""), lambda a, b: a == b), lambda x: x)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    return F.when(one == other, 1.0).when((one == "") | (other == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def range_starts(docs: DataFrame, id_col: str, parts: int) -> list:
    """Least ids of about equal ranges of the ids; parts of them at most."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null")
    found = ids.repartitionByRange(parts, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("low")).select("low").collect()
    return sorted({r.low for r in found})


def range_of(value: Column, starts: list) -> Column:
    """Index of the last start that isn't above the value, by bisection; 0 for null and below the first."""
    bounds, steps = F.lit([int(s) for s in starts]) if starts else F.array().cast("array<bigint>"), []
    step = 1
    while step <= len(starts):
        steps.insert(0, step)
        step *= 2
    at = F.lit(0)
    if not steps:
        return at
    return F.aggregate(F.lit(steps), at, lambda acc, s: F.when(F.coalesce(F.get(bounds, acc + s - 1) <= value, F.lit(False)), acc + s).otherwise(acc))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint: id, fingerprint."""
    return docs.select(id_col, fingerprint(F.col(text_col)).alias("fingerprint"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row, in order of the ids.

    The rows are dealt once by ranges of ids; each range looks ahead in itself, and its last row gets the first
    row of the next range, of which there are no more than shuffle partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(docs, id_col, parts)
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = range_of(F.col(id_col), starts)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), part.alias("part"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    heads_of = rows.where(F.col("doc_id").isNull() | (F.col("doc_id").isin(starts) if starts else F.lit(False)))
    heads = heads_of.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text")).alias("head"))
    marked = rows.withColumn("print", fingerprint(F.col("text"))).withColumn("n_chars", F.length("text").cast("bigint"))
    in_part = Window.partitionBy("part").orderBy(*order)
    seen = marked.withColumn("next", F.lead(F.struct("text", F.col("print").alias("print"))).over(in_part))
    heads = heads.select("part", F.col("head.text").alias("text")).withColumn("print", fingerprint(F.col("text")))
    by_part = Window.orderBy(F.desc("part"))  # a row for each range
    wrapped = F.first("h").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ahead = heads.select("part", F.struct("text", "print").alias("h")).select("part", F.coalesce(F.lag("h").over(by_part), wrapped).alias("ahead"))
    joined = seen.join(ahead, "part", "left").withColumn("next", F.coalesce("next", "ahead"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next.text"), F.lit(1), quarter))
    shown = joined.select("doc_id", "n_chars", edited.alias("edited"), F.col("print").alias("fingerprint"), F.col("next.print").alias("next_print"))
    done = shown.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print")
    return done.select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
