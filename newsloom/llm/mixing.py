"""Mixing sources to target weights with a time-varying curriculum. DataFrame functions only.

Every source has a weight schedule: knots (time, weight) on [0, 1], linear in between. The integral
of a source's weight over the whole run, over the sum of all integrals, is its share of the words.
A source may be repeated `max_epochs` times; what its share asks beyond that goes to the others by
weight, until none is above (the closed form of that water filling orders the sources by the level
at which they are full). A source's documents, in the order of the md5 of doc_id, are read round
and round until its target is taken; the last copy is cut where the target ends. By the time t a
source's demand is its target times the part of its integral up to t; the inverse of that turns the
words taken so far into a training position, and copies are range-sorted by position.

Sizes are measured once; all sums run over rows without texts. Running sums use two levels: parts
of the md5 order within a source, as many as its size asks for, then the few totals of the parts,
so a source that holds a third of all rows is still summed by many tasks. The text moves once to
its positions and once into their order.

Null texts and texts without a word have size 0 and are never taken. The null source is the last.
Repeated rows count each, also where all their columns are equal; a null doc_id sorts first. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import cut, small

#: Words of a part of a source's md5 order, hex digits that name a part at most, and repetitions of a source at most.
PART_WORDS, PART_DIGITS, MAX_EPOCHS = 1 << 18, 5, 3

#: The curriculum of the first, second and third source, and so on round: early, in the middle, late. Their integrals are 1, 2 and 3.
CURRICULUM = [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (0.5, 3.0), (1.0, 1.0)], [(0.0, 1.5), (1.0, 4.5)]]
Knots = list[tuple[float, float]]


def integral(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _key() -> Column:
    return F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, mx_th, source, mx_key, mx_size, mx_order) of each row of (doc_id, source, text), as a table.

    mx_th stands for the text, mx_key for the source and is never null, mx_order is the place in the source.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return cut(
        docs.select(
            "doc_id", F.xxhash64("text").alias("mx_th"), "source", _key().alias("mx_key"), n_words(F.col("text")).alias("mx_size"),
            order.alias("mx_order")
        ),
        "sizes"
    )


def source_targets(totals: DataFrame, curriculum: list[Knots] | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """mx_key, source, mx_source_size, mx_lesson, mx_target from one row (mx_key, source, mx_source_size) per source.

    Sources by code point, null last, take the schedules of the curriculum (mx_lesson) in turn; their
    weights are the schedules' integrals.
    """
    weights = F.lit([integral(k) for k in curriculum or CURRICULUM])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("mx_lesson", ((F.row_number().over(by_name) - 1) % F.size(weights)).cast("int"))
    w = w.withColumn("mx_weight", F.get(weights, F.col("mx_lesson"))).withColumn("mx_full", (F.col("mx_source_size") * max_epochs).cast("double"))
    # ascending level at which a source is full; those before a source in this order are full before it
    level = Window.orderBy(F.col("mx_full") / F.col("mx_weight"), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn(
        "mx_level",
        (F.sum("mx_source_size").over(everything) - F.coalesce(F.sum("mx_full").over(before), F.lit(0.0))) / F.sum("mx_weight").over(after)
    )
    # the first source that is not full at the level left for it sets the level of all
    fits = F.when(F.col("mx_level") <= F.col("mx_full") / F.col("mx_weight"), F.col("mx_level"))
    w = w.withColumn("mx_water", F.max(fits).over(everything))
    return w.select(
        "mx_key", "source", "mx_source_size", "mx_lesson",
        F.least(F.coalesce(F.col("mx_water") * F.col("mx_weight"), F.col("mx_full")), F.col("mx_full")).alias("mx_target")
    )


def plan(rows: DataFrame, curriculum: list[Knots] | None = None) -> DataFrame:
    """rows of sized() with mx_source_size, mx_lesson, mx_target, mx_start (words of the source before the row) and mx_taken."""
    totals = cut(rows.groupBy("mx_key", "source").agg(F.sum("mx_size").alias("mx_source_size")), "source-sizes")
    targets = cut(source_targets(totals, curriculum), "targets")
    # hex digits of the md5 order that split a source into parts of about PART_WORDS, a million parts at most
    digits = F.least(F.lit(PART_DIGITS), F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("mx_source_size") / PART_WORDS)))).cast("int")
    split = targets.select("mx_key", "mx_source_size", "mx_lesson", "mx_target", digits.alias("mx_digits"))
    placed = rows.join(small(split), "mx_key").withColumn("mx_part", F.expr("substring(mx_order, 1, mx_digits)"))
    parts = cut(placed.groupBy("mx_key", "mx_part").agg(F.sum("mx_size").alias("mx_words")), "parts")
    earlier = Window.partitionBy("mx_key").orderBy("mx_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("mx_key", "mx_part", F.coalesce(F.sum("mx_words").over(earlier), F.lit(0)).alias("mx_before"))
    inner = Window.partitionBy("mx_key", "mx_part").orderBy("mx_order", "mx_size", "mx_th").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("mx_inner", F.coalesce(F.sum("mx_size").over(inner), F.lit(0))).join(offsets, ["mx_key", "mx_part"])
    start = F.col("mx_before") + F.col("mx_inner")
    turns = F.when(F.col("mx_source_size") > 0, F.floor(F.col("mx_target") / F.col("mx_source_size"))).otherwise(0)
    last = F.floor(F.col("mx_target") - turns * F.col("mx_source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("mx_size"), last - start))
    return out.withColumn("mx_start", start).withColumn("mx_taken", (turns * F.col("mx_size") + part).cast("bigint"))


def when_taken(words: Column, target: Column, knots: Knots) -> Column:
    """Training time in [0, 1] at which a source of this target has given `words` words.

    The integral of a linear piece is quadratic; its root is taken piece by piece.
    """
    areas = [integral([a, b]) for a, b in zip(knots, knots[1:], strict=False)]
    need = F.when(target > 0, words / target).otherwise(0.0) * sum(areas)
    out = F.lit(float(knots[-1][0]))
    for i in reversed(range(len(areas))):
        (t0, w0), (t1, w1), before = knots[i], knots[i + 1], sum(areas[:i])
        slope, rest = (w1 - w0) / (t1 - t0), need - before
        step = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest)) - w0) / slope
        out = F.when(need < before + areas[i], t0 + step).otherwise(out) if areas[i] else out
    return out


def position(words: Column, curriculum: list[Knots] | None = None) -> Column:
    """Training time at which a planned row's source has given `words` words, by the row's own lesson."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(curriculum or CURRICULUM):
        out = F.when(F.col("mx_lesson") == i, when_taken(words, F.col("mx_target"), knots)).otherwise(out)
    return out


def mix(docs: DataFrame, curriculum: list[Knots] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and the first training position of every row, by position."""
    p = plan(sized(docs), curriculum)
    out = p.select(
        "doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"),
        F.col("mx_taken").alias("taken"), F.round(position(F.col("mx_start"), curriculum), 9).alias("position")
    )
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_order(docs: DataFrame, curriculum: list[Knots] | None = None) -> DataFrame:
    """A row of docs for each copy that the mix takes, range-sorted by training position.

    The last copy of a source's target holds only the words that are taken, joined by one space.
    """
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "source", "text")]
    packed = F.struct(*others) if others else F.lit(None).cast("string")
    p = plan(sized(docs), curriculum)
    copies = F.expr("sequence(0, cast(ceil(mx_taken / mx_size) - 1 as int))")
    p = p.where("mx_taken > 0").select(
        "doc_id", "mx_th", "mx_key", "mx_size", "mx_taken", "mx_source_size", "mx_start", "mx_target", "mx_lesson", copies.alias("mx_copies")
    )
    # equal rows of one id are told apart by their number, so each takes one of the planned places
    twins = Window.partitionBy("mx_doc", "mx_text", "mx_from")
    named = [F.col("doc_id").alias("mx_doc"), F.col("mx_th").alias("mx_text"), F.col("mx_key").alias("mx_from")]
    places = p.select(
        *named, "mx_size", "mx_taken", "mx_source_size", "mx_start", "mx_target", "mx_lesson", "mx_copies"
    ).withColumn("mx_nth", F.row_number().over(twins.orderBy("mx_start")))
    texts = docs.select(packed.alias("mx_others"), "doc_id", "source", "text", F.xxhash64("text").alias("mx_th"), _key().alias("mx_key"))
    texts = texts.withColumn("mx_twin", F.row_number().over(Window.partitionBy("doc_id", "mx_th", "mx_key").orderBy(F.xxhash64("mx_others"))))
    same = F.expr("doc_id <=> mx_doc and mx_th = mx_text and mx_key = mx_from and mx_twin - mx_nth = 0")
    out = texts.join(places, same).select(
        "mx_others", "doc_id", "source", "text", "mx_size", "mx_taken", "mx_source_size", "mx_start", "mx_target", "mx_lesson",
        F.explode("mx_copies").alias("mx_copy")
    )
    at = position(F.col("mx_copy") * F.col("mx_source_size") + F.col("mx_start"), curriculum)
    left = F.col("mx_taken") - F.col("mx_copy") * F.col("mx_size")
    out = out.select("mx_others", "doc_id", "source", "text", "mx_copy", F.when(left < F.col("mx_size"), left).alias("mx_left"), at.alias("mx_at"))
    out = out.repartitionByRange("mx_at", "doc_id", "mx_copy").sortWithinPartitions("mx_at", "doc_id", "mx_copy")
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col("mx_left").cast("int")), " ")
    text = F.when(F.col("mx_left").isNull(), F.col("text")).otherwise(some)
    named = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": text}
    if "n_chars" in others:
        named["n_chars"] = F.when(F.col("mx_left").isNull(), F.col("mx_others.n_chars")).otherwise(F.length(text))
    return out.select(*((named[c] if c in named else F.col(f"mx_others.`{c}`")).alias(c) for c in columns))
