"""Mixing sources to target weights along a time-varying curriculum.

A source has a weight schedule: knots (time, weight), linear in between.  The integral of the
schedule is the source's weight; the words of all sources are shared out by weight, but a
source gives at most ``max_repeats`` times its own words, and what it can't give is shared
again among the others.  That is the source's target.

The documents of a source stand in a fixed random order and are read round and round until the
target is met to the word, so the last one may be taken in part.  The demand for the source's
words up to a time is the target times the share of the schedule's integral that lies before
it; the inverse of this curve turns the place of a document's middle word in the source's
stream into its time, its training position.  All documents, sorted by range of position, are
the curriculum.

Cases: a null or empty text has size 0 and is never taken; a null source is a source; a source
without a schedule has weight 0 and target 0; if no source has words, all targets are 0;
repeated ids and rows each count; an empty table gives an empty result.  Extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import text_or_empty, written
from pricelens.llm.order import joined_by_key, placed

MAX_REPEATS = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def integrated(schedule: DataFrame) -> DataFrame:
    """(source, weight, pieces) of a schedule (source, time, weight): its integral, and for
    each piece between two knots the times, the weights and the integral before it (``t0 t1 w0
    w1 y0 y1``).  Knots of one source and time: the smaller weight ends the piece before, the
    larger begins the next."""
    knot = F.struct(F.col("time").cast("double").alias("time"), F.col("weight").cast("double").alias("weight"))
    knots = schedule.groupBy("source").agg(F.sort_array(F.collect_list(knot)).alias("k"))
    one = lambda i: F.struct(
        F.get("k", i - 1)["time"].alias("t0"),
        F.get("k", i)["time"].alias("t1"),
        F.get("k", i - 1)["weight"].alias("w0"),
        F.get("k", i)["weight"].alias("w1"),
    )
    pieces = F.when(F.size("k") > 1, F.transform(F.sequence(F.lit(1), F.size("k") - 1), one))
    knots = knots.select("source", pieces.alias("p"))
    area = F.transform("p", lambda p: (p["t1"] - p["t0"]) * (p["w0"] + p["w1"]) / 2)
    knots = knots.select("source", "p", area.alias("a"))
    up_to = lambda i: F.aggregate(F.slice("a", 1, i), F.lit(0.0), lambda x, y: x + y)
    summed = F.transform("p", lambda p, i: p.withField("y0", up_to(i)).withField("y1", up_to(i + 1)))
    return knots.select("source", F.coalesce(up_to(F.size("a")), F.lit(0.0)).alias("weight"), summed.alias("pieces"))


def time_of(share: Column, weight: Column, pieces: Column) -> Column:
    """When ``share`` (0 to 1) of a schedule's integral is reached."""
    y = share * weight
    p = F.coalesce(
        F.get(F.filter(pieces, lambda p: (p["y1"] > p["y0"]) & (y <= p["y1"])), F.lit(0)),
        F.element_at(pieces, -1),
    )
    gone = F.greatest(y - p["y0"], F.lit(0.0))
    slope = F.coalesce(F.try_divide(p["w1"] - p["w0"], p["t1"] - p["t0"]), F.lit(0.0))
    below = p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * gone, F.lit(0.0)))
    return F.when(below > 0, F.least(p["t0"] + 2 * gone / below, p["t1"])).otherwise(p["t0"])


def targets(sources: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size, weight, ...) and each one's ``target``: the sum of all
    sizes shared by weight, none above ``max_repeats`` times its size.  A round finds the
    sources that the common rate lifts above their limit and shares the rest among the others;
    three numbers of a round reach the driver."""
    limit = F.col("source_size") * float(max_repeats)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    held = None
    while True:
        full = limit <= F.col("weight") * rate if held is not None else F.lit(False)
        at_limit, open_weight, n = sources.agg(
            F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("bigint"))
        ).first()
        if n == held or not open_weight:
            break
        held = n
        rate = (total - (at_limit or 0.0)) / open_weight
    if held is None:  # no source has a weight
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(rate)))


def mix(
    df: DataFrame,
    schedule: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """One row per row of ``df``: its id, source, size in words, source_size, target, and
    ``copies``, an array of (repeat, words, position): what the mix takes of the document and
    when.  ``schedule`` has the columns source, time and weight."""
    size = F.coalesce(F.regexp_count(text_or_empty(df, text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = written(
        df.select(
            df[id_col].alias("id"),
            df[source_col].alias("source"),
            size.alias("size"),
            F.md5(df[id_col].cast("string")).alias("key"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    docs = placed(sizes, [F.col("source"), F.col("key"), F.col("size"), F.col("tie")], "size")
    found = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("first"))
    plan = integrated(schedule).withColumnRenamed("source", "planned")
    found = found.join(plan, F.col("source").eqNullSafe(F.col("planned")), "left").drop("planned")
    sources = targets(written(found.withColumn("weight", F.coalesce("weight", F.lit(0.0)))), max_repeats)
    docs = joined_by_key(docs, sources, "source", "tie")

    due = F.floor(F.col("target") + 0.5).cast("bigint")
    start = F.col("before") - F.col("first")

    def copy(repeat: Column) -> Column:
        at = repeat * F.col("source_size") + start
        words = F.greatest(F.least(F.col("size"), due - at), F.lit(0))
        position = time_of((at + words / 2) / F.greatest(due, F.lit(1)), F.col("weight"), F.col("pieces"))
        return F.struct(repeat.alias("repeat"), words.alias("words"), position.alias("position"))

    repeats = F.sequence(F.lit(0), F.lit(max(math.ceil(max_repeats) - 1, 0)))
    copies = F.filter(F.transform(repeats, copy), lambda c: c["words"] > 0)
    return docs.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The curriculum: one row per copy of ``mix``, sorted by position over all sources."""
    rows = mixed.select(*[c for c in mixed.columns if c != "copies"], F.explode("copies").alias("copy"))
    rows = rows.select(*[c for c in mixed.columns if c != "copies"], "copy.*")
    return rows.orderBy("position", mixed.columns[0], "repeat")


def alternating_schedule(df: DataFrame, weights: list[float], source_col: str = "source", tilt: float = 0.5) -> DataFrame:
    """A schedule for the sources of ``df``: by code point, null last, they weigh as ``weights``
    says, again and again.  The greatest weights fall from 1 + tilt to 1 - tilt times
    themselves over the course, the least rise likewise, the others stay."""
    found = placed(df.select(df[source_col].alias("source")).distinct(), [F.col("source").asc_nulls_last()])
    turn = (F.col("place") % len(weights)).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    lean = F.when(weight == float(max(weights)), -tilt).when(weight == float(min(weights)), tilt).otherwise(0.0)
    knots = F.array(
        F.struct(F.lit(0.0).alias("time"), (weight * (1 - lean)).alias("weight")),
        F.struct(F.lit(1.0).alias("time"), (weight * (1 + lean)).alias("weight")),
    )
    return found.select("source", F.explode(knots).alias("knot")).select("source", "knot.*")
