"""Column functions on base and quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """X3/P9. Other letters than ACGT stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def fixed_slice(seq: Column, start: int, length: int) -> Column:
    """Length letters from the 1-based start, padded with N where the sequence is short."""
    return F.rpad(F.substring(seq, start, length), length, "N")


def hamming(a: Column, b: Column) -> Column:
    """Places at which two sequences of one length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def n_class(seq: Column) -> Column:
    """-1 without N, its 0-based place with one, -2 with more."""
    n = F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))
    return F.when(n == 0, -1).when(n == 1, F.instr(seq, "N") - 1).otherwise(-2)


def umi_status(umi: Column) -> Column:
    """why a molecule tag is refused (holds N, one letter only), null if it isn't."""
    return F.when(F.instr(umi, "N") > 0, "N").when(umi.rlike("^(A+|C+|G+|T+)$"), "homopolymer")


def two_bit(seq: Column) -> Column:
    """The sequence as a number in base four, A C G T as 0 to 3."""
    return F.aggregate(F.split(seq, ""), F.lit(0).cast("bigint"), lambda s, x: s * 4 + F.instr(F.lit("CGT"), x) * F.when(x == "", 0).otherwise(1))


def phred(letter: Column) -> Column:
    return F.ascii(letter) - 33


def error_probability(letter: Column) -> Column:
    """X4."""
    return F.pow(F.lit(10.0), -phred(letter) / 10.0)


def quality_cut(quals: Column, cutoff: int) -> Column:
    """Length kept by the 3' quality trim: from the end, sum cutoff - q, stop below 0, cut at the maximum.

    quals: array of numbers. P5 is the same on the reversed array."""
    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best"), F.lit(0).alias("cut"), F.lit(0).alias("at"), F.lit(True).alias("on"))

    def step(s: Column, q: Column) -> Column:
        total = s["sum"] + (F.lit(cutoff) - q)
        on = s["on"] & (total >= 0)
        better = on & (total > s["best"])
        return F.struct(F.when(on, total).otherwise(s["sum"]).alias("sum"), F.when(better, total).otherwise(s["best"]).alias("best"), F.when(better, s["at"] + 1).otherwise(s["cut"]).alias("cut"), (s["at"] + 1).alias("at"), on.alias("on"))

    return F.size(quals) - F.aggregate(F.reverse(quals), state, step, lambda s: s["cut"])


def read_name(name: Column) -> Column:
    """P10: without the leading @, what follows the first space, and a final /1 or /2."""
    return F.regexp_replace(F.regexp_extract(name, r"^@?(\S*)", 1), r"/[12]$", "")


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op)."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), 1)
    op = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), 1)
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("int").alias("n"), b.alias("op")))


def cigar_span(cigar: Column, ops: str = "MDN=X") -> Column:
    """Reference bases that an alignment spans."""
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda s, x: s + F.when(F.instr(F.lit(ops), x["op"]) > 0, x["n"]).otherwise(0))


def cigar_blocks(cigar: Column, start: Column) -> Column:
    """Reference blocks (start, end, closed) of the matched stretches."""
    zero = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        match = x["op"].isin("M", "=", "X")
        move = F.when(F.instr(F.lit("MDN=X"), x["op"]) > 0, x["n"]).otherwise(0)
        block = F.struct(s["at"].alias("start"), (s["at"] + x["n"] - 1).alias("end"))
        return F.struct((s["at"] + move).alias("at"), F.when(match, F.concat(s["out"], F.array(block))).otherwise(s["out"]).alias("out"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda s: s["out"])


def strand_tag(flag: Column, reverse_library: bool = False) -> Column:
    """+ or - from the alignment flag (reverse 16, second mate 128) and the library."""
    odd = ((flag.bitwiseAND(16) != 0).cast("int") + (flag.bitwiseAND(128) != 0).cast("int") + F.lit(int(reverse_library))) % 2
    return F.when(odd == 0, "+").otherwise("-")


def hash31(text: Column, buckets: int) -> Column:
    """Polynomial hash modulo the number of buckets (each step reduced, which gives the same residue)."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)) % buckets)


def log_factorial(n: Column) -> Column:
    """Ln n! by summation; for small n."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), n.cast("int"))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double"))))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X >= k) of Binomial(n, p)."""
    import math

    ratio = math.log(p / (1 - p))
    zero = F.struct((n.cast("double") * math.log(1 - p)).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] + F.log((n - i).cast("double") / (i + 1)) + ratio).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum"))
    below = F.aggregate(F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))), zero, step, lambda s: s["sum"])
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - below))


def alignment_score(length: Column, scale: float = 0.25) -> Column:
    """The genomic length penalty ceil(log2(length) * scale - 0.5), not below 0."""
    return F.greatest(F.lit(0), F.ceil(F.log2(length.cast("double")) * scale - 0.5)).cast("int")


def candidate_score(as_: Column, nm: Column) -> Column:
    """X14."""
    return F.when(as_ != 0, as_).when(nm >= 0, -nm).otherwise(0)


def translate_feature_barcode(cb: Column) -> Column:
    """P20: the feature chemistry's barcode: letters 8 and 9 complemented."""
    return F.concat(F.substring(cb, 1, 7), F.translate(F.substring(cb, 8, 2), "ACGT", "TGCA"), F.substring(cb, 10, 1000))


# fixed values: start and multiplier of the 64-bit FNV-1a hash; start of djb2
FNV_START, FNV_PRIME, DJB2_START = 0xCBF29CE484222325, 0x100000001B3, 5381
_LOW = (1 << 32) - 1


def _bytes_hash(text: Column, start: int, step) -> Column:
    """16 hex digits of a 64-bit hash over the UTF-8 bytes; the state is two halves of 32 bits, so that no product overflows."""
    state = F.struct(F.lit(start >> 32).cast("bigint").alias("hi"), F.lit(start & _LOW).cast("bigint").alias("lo"))
    octets = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1,"), ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint"))
    end = F.aggregate(octets, state, step)
    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.concat(half(end["hi"]), half(end["lo"]))


def fnv1a(text: Column) -> Column:
    """X9."""
    low = FNV_PRIME & _LOW  # the multiplier is 2**40 and this

    def step(s: Column, b: Column) -> Column:
        lo, hi = s["lo"].bitwiseXOR(b), s["hi"]
        product = lo * low
        high = hi * low + F.shiftrightunsigned(product, 32) + lo * 256
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return _bytes_hash(text, FNV_START, step)


def djb2(text: Column) -> Column:
    """X9."""

    def step(s: Column, b: Column) -> Column:
        low = s["lo"] * 33 + b
        return F.struct((s["hi"] * 33 + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(_LOW)).alias("hi"), low.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return _bytes_hash(text, DJB2_START, step)


def poly_tail(seq: Column, letter: str = "A", least: int = 20, share: int = 7, drop: int = 27) -> Column:
    """Length of the tail of one letter: from the end, 1 for each of it and -2 for others, the longest stretch with at least
    ``share`` tenths of its length as score; the search ends where length less score is over ``drop``. 0 if that score is below
    ``least`` or the read is shorter."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(0).alias("length"), F.lit(0).alias("best"), F.lit(True).alias("on"))

    def step(s: Column, c: Column) -> Column:
        hit, at = c == letter, s["at"] + 1
        score = s["score"] + F.when(hit, 1).otherwise(-2)
        longer = s["on"] & hit & (score * 10 >= at * share)
        on = s["on"] & (hit | (at - score <= drop))
        return F.struct(at.alias("at"), score.alias("score"), F.when(longer, at).otherwise(s["length"]).alias("length"), F.when(longer, score).otherwise(s["best"]).alias("best"), on.alias("on"))

    end = F.aggregate(F.reverse(F.split(seq, "")), zero, step)
    return F.when((F.length(seq) >= least) & (end["best"] >= least), end["length"]).otherwise(0)
