"""Operator 7: mixing sources to target weights by a low-discrepancy schedule.

1. Targets. Sources in order of code points, null last, weigh ``WEIGHTS`` in turn and share ``share`` of all words;
   none gets more than ``repeats`` times what it has, and the excess is shared again by weight until none is above.
   In closed form: sorted by capacity over weight, a source is full while its ratio lies below the level that
   the rest would reach.
2. Blocks. A source's documents are put in order of a keyed hash and laid end to end; its words are cut into blocks
   of equal length: ``words_per_block`` (from the total) words, but ``least_blocks`` blocks at least.
3. Schedule. Slot t takes the point frac(t * golden ratio). The points fall into the sources' shares of the slots,
   laid end to end over [0, 1); the slots of a source, ranked by t, take its blocks in turn, beginning again at the
   end, ``repeats`` times at most.
4. A document's words taken are those of its places in the blocks, as often as the blocks are taken.

Ranks and running sums are taken in two steps, by chunks and over the chunks, so that a source with any share of the
rows is spread over all tasks. Slots find their source by an equi-join on cells of [0, 1).

Defined results: null and empty texts have size 0 and none taken; a source without words has target 0; the null
source is one source; rows with equal ids are documents of their own, and equal rows keep whatever order the
partitioned sort gives them, which changes no result; reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, map_batches
from .vec import slices, text_buffer, white_words

WEIGHTS = (5, 2, 1)
GOLDEN = 0.6180339887498949
_CHUNKS = 512


def words_in(text: Column) -> Column:
    """Number of words between ASCII white space."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    n = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1
    return F.when(spaced == "", F.lit(0)).otherwise(n).cast("bigint")


def targets(sizes: DataFrame, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """source, source_size, weight, target; sizes: source, size. One row for each source goes through the windows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(WEIGHTS)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.lit([float(x) for x in WEIGHTS]), turn % n)
    per = per.select("source", "source_size", w.alias("weight"), (F.col("source_size") * repeats).cast("double").alias("room"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    rising = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("open", F.col("room") / F.col("weight") > F.col("level"))
    water = F.min(F.when(F.col("open"), F.struct((F.col("room") / F.col("weight")).alias("r"), "level"))).over(everything)["level"]
    return per.select("source", "source_size", "weight", F.when(water.isNull(), F.col("room")).otherwise(F.least("room", F.col("weight") * water)).alias("target"))


def _chunked(rows: DataFrame, group: list[str], chunk: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Running sum of value before each row, in each group, in order of (chunk, order)."""
    rows = rows.withColumn("_chunk", chunk).withColumn("_value", value)
    sums = rows.groupBy(*group, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_chunk").alias("_c"), before.alias("_before"))
    inner = F.coalesce(F.sum("_value").over(Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_inner", inner)
    on = (F.col("_chunk") == F.col("_c"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    joined = rows.join(sums, on, "left")
    return joined.withColumn(name, (F.col("_inner") + F.col("_before")).cast("bigint")).drop("_chunk", "_value", "_inner", "_before", "_c", *[f"_{g}" for g in group])


@dataclass
class Mix:
    documents: DataFrame  # input key, source, size, source_size, target, start (place of its first word), blocks, block_words
    schedule: DataFrame  # slot, source, block, epoch


def _turn(seed: int, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def mix(docs: DataFrame, share: float = 1.5, repeats: int = 2, slots: int = 1 << 20, least_blocks: int = 1024, cells: int = 4096, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The schedule and the documents' places in their sources. slots: about so many blocks are taken in all."""
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), _turn(seed, id_col, text_col).alias("turn")))
    aims = targets(rows.select("source", "size"), share, repeats)
    # blocks of a source: of equal length
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_block = F.greatest(F.lit(1.0), F.sum("target").over(everything) / F.lit(float(slots)))
    n = F.least(F.col("source_size"), F.greatest(F.ceil(F.col("source_size") / per_block), F.lit(least_blocks)))
    aims = aims.withColumn("blocks", n.cast("bigint")).withColumn("wanted", F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("wanted").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    aims = cut(aims.withColumn("below", below).withColumn("number", F.row_number().over(in_order) - 1).withColumn("all", F.sum("wanted").over(everything)))
    total = aims.agg(F.max("all").alias("n")).first().n or 0.0
    slots_n = round(total)
    low, high = F.col("below") / F.col("all"), (F.col("below") + F.col("wanted")) / F.col("all")
    shares = aims.where("wanted > 0").select("number", "blocks", low.alias("low"), high.alias("high"))
    shares = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    points = spark.range(slots_n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells))
    taken = points.join(shares, "cell").where("low <= point and point < high").select("slot", "number", "blocks")
    width = max(1, -(-slots_n // _CHUNKS))
    taken = _chunked(taken, ["number"], F.floor(F.col("slot") / width), [F.col("slot")], F.lit(1), "rank")
    schedule = taken.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).where(F.col("epoch") < repeats).select("slot", "number", (F.col("rank") % F.col("blocks")).alias("block"), "epoch")
    placed = _chunked(rows, ["source"], F.pmod(F.shiftright("turn", 40), F.lit(_CHUNKS)), [F.col("turn"), F.col("doc_id"), F.col("size")], F.col("size"), "start")
    aim = aims.select(F.col("source").alias("_s"), "number", "source_size", "target", "blocks")
    documents = placed.join(aim, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return Mix(documents, schedule)


def _bounds(block: Column) -> Column:
    """First place of a block in its source."""
    return F.floor(block * F.col("source_size") / F.col("blocks")).cast("bigint")


def pieces(m: Mix) -> DataFrame:
    """Each document cut at its source's block ends: its columns, block, first and stop (places in the document)."""
    last = F.col("start") + F.col("size") - 1
    near = lambda place: F.floor(place * F.col("blocks") / F.col("source_size")).cast("bigint")
    around = F.sequence(F.greatest(F.lit(0), near(F.col("start")) - 1), F.least(F.col("blocks") - 1, near(last) + 1))
    cutup = m.documents.where("size > 0").withColumn("block", F.explode(around))
    first = F.greatest(F.col("start"), _bounds(F.col("block"))) - F.col("start")
    stop = F.least(F.col("start") + F.col("size"), _bounds(F.col("block") + 1)) - F.col("start")
    return cutup.withColumn("first", first).withColumn("stop", stop).where("first < stop")


def taken(docs: DataFrame, **how) -> DataFrame:
    """Per row: id, size, source_size, target, taken."""
    m = mix(docs, **how)
    uses = m.schedule.groupBy("number", "block").agg(F.count("*").alias("uses"))
    parts = pieces(m).join(uses, ["number", "block"])
    by_doc = parts.groupBy("number", "start").agg(F.sum((F.col("stop") - F.col("first")) * F.col("uses")).alias("taken"))
    some = m.documents.where("size > 0").join(by_doc, ["number", "start"], "left")
    none = m.documents.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    id_col = how.get("id_col", "doc_id")
    return some.unionByName(none, allowMissingColumns=True).select(F.col("doc_id").alias(id_col), "size", "source_size", F.col("target"), F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_texts(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: a row with all columns of docs for each document and time round in which words of it are taken.
    The text is those words, with what stands between them; a line break joins words of blocks that aren't neighbours."""
    m = mix(docs, seed=seed, id_col=id_col, text_col=text_col, **how)
    parts = pieces(m).join(m.schedule.select("number", "block", "epoch"), ["number", "block"])
    ranges = parts.groupBy("number", "start", "doc_id", "turn", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("__mix_ranges"))
    ranges = ranges.select(F.col("doc_id").alias("__mix_id"), F.col("turn").alias("__mix_t"), "__mix_ranges")
    rows = docs.withColumn("__mix_turn", _turn(seed, id_col, text_col)).dropDuplicates([id_col, "__mix_turn"])
    joined = rows.join(ranges, (F.col("__mix_turn") == F.col("__mix_t")) & F.col(id_col).eqNullSafe(F.col("__mix_id"))).select(*[F.col(f"`{c}`") for c in docs.columns], "__mix_ranges")

    def kernel(batches):
        for batch in slices(batches, text_col, 1 << 20):
            at = batch.schema.get_field_index(text_col)
            buf, off = text_buffer(batch.column(at))
            start, stop, word_off = white_words(buf, off)
            out = []
            for i, spans in enumerate(batch.column(batch.num_columns - 1)):
                a, b = start[word_off[i] : word_off[i + 1]], stop[word_off[i] : word_off[i + 1]]
                merged: list[list[int]] = []
                for first, end in zip(spans.values.field("first").to_pylist(), spans.values.field("stop").to_pylist(), strict=True):
                    if merged and merged[-1][1] == first:
                        merged[-1][1] = end
                    else:
                        merged.append([first, end])
                out.append("\n".join(buf[a[x] : b[y - 1]].tobytes().decode("utf-8", "surrogatepass") for x, y in merged))
            columns = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return map_batches(joined, kernel, docs.schema)
