"""Mixing sources to target weights.

Sizes are added up by source; the targets share a budget by weight, none above ``cap`` times its source, what is over
going to the others by weight (water filling).  With rate = target / source size, each document is taken floor(rate)
times plus once more with probability rate - floor(rate), by a hash of its id (without one, of its text) and a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import WORD, cut, fresh

#: Sources are broadcast to the documents up to this many (a few MB); more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 50_000

#: The sources' totals, a row each, are ordered in one task; more sources than this are an error.
MAX_SOURCES = 1_000_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """[0, 1) from md5 of key and seed: the same on every engine, run and partitioning. A null key counts as ''."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` (one row each, already added up) with ``weight``: the weights in turn, by code point, null last."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))


def targets(sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size, weight``: target = min(cap * size, level * weight).

    The level is found in one pass over the sources, which fill up in the order of cap * size / weight.  A share above
    ``cap`` can't be reached; then every target is its cap.  A source of size 0 has target 0.
    """
    ratio = F.col("limit") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = sizes.withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("level", left / weight_left)
    # The first source, in filling order, that its level leaves below its limit sets the level of all that follow.
    # Levels only fall behind it, so of equal ratios the highest level is the first.
    open_ = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct(ratio.alias("r"), (-F.col("level")).alias("down")))
    level = -F.min(open_).over(all_rows)["down"]
    return ranked.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))).select("source", "source_size", "weight", "target")


def source_targets(docs: DataFrame, weights: tuple[float, ...], *, share: float = 1.5, cap: float = 2.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The targets of ``docs``, whose sources take the weights in turn; cut from its lineage, one row a source."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(word_count(F.col(text_col))).alias("source_size"))
    sizes = cut(sizes)
    if sizes.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return cut(targets(cyclic_weights(sizes, weights), share, cap))


def plan_mix(docs: DataFrame, targets: DataFrame, *, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns size, source_size, target and copies added, and the names they got (no clash with docs').

    Repeated rows, and different texts of one id, get equally many copies: the draw is a hash of the id, or of the text where
    the id is null.  A null source is a source of its own.  A source that ``targets`` lacks is taken 0 times.  A null or empty
    text has size 0; a very long one counts whole.
    """
    names: dict[str, str] = {}
    for x in ("size", "source_size", "target", "copies"):
        names[x] = fresh(docs, f"mix_{x}")
    known = targets.select(F.col("source").alias("mix_key"), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]))
    if targets.count() <= MAX_BROADCAST_SOURCES:
        known = F.broadcast(known)
    out = docs.join(known, F.col(source_col).eqNullSafe(F.col("mix_key")), "left").drop("mix_key")
    out = out.withColumn(names["size"], word_count(F.col(text_col)))
    rate = F.when(F.col(names["source_size"]) > 0, F.col(names["target"]) / F.col(names["source_size"])).otherwise(F.lit(0.0))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    more = (unit_hash(key, seed) < rate - F.floor(rate)).cast("int")
    return out.withColumn(names["copies"], F.floor(rate).cast("int") + more), names


def mix(docs: DataFrame, weights: tuple[float, ...], *, share: float = 1.5, cap: float = 2.0, seed: int = 17, **columns: str) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as its source's rate and its draw say; same columns."""
    reading = {k: v for k, v in columns.items() if k != "id_col"}
    planned, names = plan_mix(docs, source_targets(docs, weights, share=share, cap=cap, **reading), seed=seed, **columns)
    again = fresh(docs, "mix_again")
    repeated = planned.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(names["copies"]))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
