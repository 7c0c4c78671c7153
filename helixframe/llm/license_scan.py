"""Operator 5: license scans by ordered signature rules, in Spark expressions only.

A text is put in normal form (see :mod:`license_rules`). A rule's pattern is run only where its keyword occurs; a
first gate of the few word pieces that every keyword holds one of passes over most texts. All matches become
detections (rule, first word, word after the last). A detection contained in that of a rule with higher priority is
suppressed, and so is one contained in a longer one, or an equal one of an earlier rule, of the same priority.
Detections of base phrases are never suppressed. The score is 1 - prod(1 - confidence) over what is left.

Defined results: null and empty texts have no words and no detections (empty label lists, score 0, null places);
repeated rows get equal results; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import let
from .license_rules import BASE, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CUT = "\x01"
#: Elements of an array that is gathered are added to a block of so many.
BLOCK = 256
_DETECTION = "struct<start:bigint,stop:bigint,rule:int,label:string,priority:int,confidence:double>"


def stems() -> list[str]:
    """Pieces of text one of which every keyword holds."""
    found: list[str] = ["licen"]
    for k in sorted({k for _, _, _, k, _ in rules()}, key=lambda k: (len(k), k)):
        if not any(s in k for s in found):
            found.append(k)
    return found


def normal_form(text: Column) -> Column:
    """Words of the lower-cased text joined by single spaces, a space at either end."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _GAP, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def _rule_table() -> Column:
    rows = [F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(k).alias("keyword"), F.lit(f"(?<= )(?:{x})(?= )").alias("pattern")) for i, (label, p, c, k, x) in enumerate(rules())]
    return F.array(*rows)


def _gathered(items: Column, kind: str, state: dict[str, Column], step) -> Column:
    """Fold over items that gathers an array of ``kind``: step(state, item) gives the new state and the element to add (null:
    none). Elements are gathered in blocks, so that an array is never copied for each of them."""
    none = F.array().cast(f"array<{kind}>")
    first = F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), none.alias("open"), *[v.alias(k) for k, v in state.items()])

    def add(acc: Column, item: Column) -> Column:
        # neither let() nor a change of type where all that is gathered so far would be copied for it
        new, one = step(acc, item)
        added = F.when(one.isNull(), none).otherwise(F.array(one.cast(kind))).cast(f"array<{kind}>")
        over = F.size(acc["open"]) >= BLOCK
        full = F.when(over, F.concat(acc["full"], F.array(acc["open"]).cast(f"array<array<{kind}>>"))).otherwise(acc["full"])
        return F.struct(full.alias("full"), F.when(over, added).otherwise(F.concat(acc["open"], added)).alias("open"), *[new[k].alias(k) for k in state])

    return F.aggregate(items, first, add, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["open"]))))


def detections(normal: Column) -> Column:
    """All matches of all rules in a text in normal form."""

    def of_rule(rule: Column) -> Column:
        pieces = F.split(F.regexp_replace(normal, rule["pattern"], F.lit(f"{_CUT}$0{_CUT}")), _CUT)

        def step(acc: Column, piece: Column):
            n = _spaces(piece)
            one = F.struct(acc["at"].alias("start"), (acc["at"] + n + 1).alias("stop"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"))
            return {"at": acc["at"] + n, "hit": ~acc["hit"]}, F.when(acc["hit"], one)

        return _gathered(pieces, _DETECTION, {"at": F.lit(-1).cast("bigint"), "hit": F.lit(False)}, step)

    return F.flatten(F.transform(F.filter(_rule_table(), lambda r: F.contains(normal, r["keyword"])), of_rule))


def kept(found: Column) -> Column:
    """Detections that none with a better claim contains. In order of start, then longest, highest priority and earliest rule
    first, a detection is contained in an earlier one of no lower priority exactly if the furthest stop of those so far is not
    before its own; so one furthest stop for each priority is carried along."""
    base = len(BASE)
    levels = sorted({p for _, p, _, _, _ in rules()})
    keyed = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("far"), (-d["priority"]).alias("low"), d["rule"].alias("rule"), d.alias("d")))

    def step(acc: Column, x: Column):
        d = x["d"]
        ahead = F.exists(acc["stops"], lambda s: (s["priority"] >= d["priority"]) & (s["stop"] >= d["stop"]))
        stops = F.transform(acc["stops"], lambda s: F.struct(s["priority"].alias("priority"), F.when(s["priority"] == d["priority"], F.greatest(s["stop"], d["stop"])).otherwise(s["stop"]).alias("stop")))
        return {"stops": stops}, F.when((d["rule"] < base) | ~ahead, d)

    none = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(-1).cast("bigint").alias("stop")) for p in levels])
    return F.when(F.size(found) < 2, found).otherwise(_gathered(F.array_sort(keyed), _DETECTION, {"stops": none}, step))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, detections (those kept) of the whole text."""

    def result(normal: Column) -> Column:
        gate = None
        for stem in stems():
            hit = F.contains(normal, F.lit(stem))
            gate = hit if gate is None else gate | hit
        none = F.array().cast(f"array<{_DETECTION}>")
        n = F.when(F.octet_length(normal) <= 2, F.lit(0).cast("bigint")).otherwise(_spaces(normal) - 1)
        return F.struct(n.alias("n_words"), F.when(gate, let(detections(normal), kept)).otherwise(none).alias("detections"))

    rows = docs.select(F.col(id_col).alias("id"), let(normal_form(F.col(text_col)), result).alias("r"))
    return rows.select(F.col("id").alias(id_col), F.col("r.n_words").alias("n_words"), F.col("r.detections").alias("detections"))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    base = lambda d: F.filter(d, lambda x: x["rule"] < len(BASE))
    names = lambda d: F.array_join(F.array_sort(F.array_distinct(F.transform(d, lambda x: x["label"]))), ",")

    def shown(d: Column) -> Column:
        b = base(d)
        starts = F.transform(b, lambda x: x["start"])
        miss = F.aggregate(d, F.lit(1.0), lambda acc, x: acc * (1 - x["confidence"]))
        return F.struct(F.size(b).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(b).alias("base_labels"), names(d).alias("labels"), (1 - miss).alias("score"), F.size(d).cast("bigint").alias("n_detections"))

    rows = scan(docs, id_col, text_col).select(id_col, "n_words", let(F.col("detections"), shown).alias("s"))
    return rows.select(id_col, "n_words", "s.*")
