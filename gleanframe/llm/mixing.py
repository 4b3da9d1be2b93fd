"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document of the source is wanted ``target / source
size`` times. The whole part of that is sure. The fractional parts are rounded by the pivotal
method: two fractions meet, mass is moved between them at random, weighted by the documents' sizes
so that the words kept stay the same, until one of them is 0 or 1. That one is decided, the other
goes on. Each document keeps its expected number of copies, and the words of a source miss its
target by no more than the one fraction that is left at the end.

The meetings form a reduction tree: groups of about ``FAN_IN`` neighbours (by a hash) of one source
are folded at once, each hands one residual to the next level, and the levels run until one residual
for each source is left. So no group grows with its source, and level k moves a ``FAN_IN ** k``-th
of the documents. Randomness is a hash of the seed and the rows that meet: reruns agree.

Rows alike in id, source and size are one unit with a multiplicity, so repeated rows cannot fill a
group. Everything is a DataFrame expression. Weights and targets need the sources in order: one row
for each source passes one task, as the contract numbers them over all sources.

Defined results: a null text has size 0; a null source is a source, after all others; documents
without words are rounded on their own, and sources without words get target 0 and no copies. An
empty table gives an empty table. Repeated rows share the copies of their unit as evenly as they can.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanframe.llm.common import let, unused, words_of, written

#: Fractions that meet in one group of the reduction tree, on average.
FAN_IN = 32


def source_targets(
    sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Per source its size and target.

    ``sized`` has ``source`` and ``size``. The targets share ``share`` times all sizes by weight,
    and stop at ``most`` times the source; what is above goes to the others by weight. That is one
    level for all open sources, found from the sources in the order in which they fill.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number % len(weights) + 1)
    filling = Window.orderBy("room", "number")
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda name: F.coalesce(F.sum(name).over(below), F.lit(0.0))
    whole = lambda name: F.sum(name).over(everywhere)
    return (
        sources.withColumn("number", number)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(most)))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn(
            "level",
            (whole("source_size") * share - before("most")) / (whole("weight") - before("weight")),
        )
        .withColumn(
            "open", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "number", "level"))).over(everywhere)
        )
        .select(
            "source",
            "source_size",
            F.least(
                F.col("most"),
                F.coalesce(F.col("open.level") * F.col("weight"), F.col("most")),
            ).alias("target"),
        )
    )


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _meet(a: Column, b: Column, seed: int) -> Column:
    """Struct of two rows of which ``done`` has ``p`` 0 or 1 and ``open`` the rest of the mass."""
    part = lambda x, p: F.struct(
        x["unit"].alias("unit"), x["size"].alias("size"), p.alias("p")
    )
    ratio = b["size"] / a["size"]
    bounds = F.struct(
        F.least(1 - a["p"], b["p"] * ratio).alias("up"),
        F.least(a["p"], (1 - b["p"]) * ratio).alias("down"),
        ratio.alias("ratio"),
        _uniform(F.lit(seed), a["unit"], b["unit"]).alias("u"),
    )
    pair = lambda done, p, rest, q: F.struct(
        part(done, F.lit(p)).alias("done"), part(rest, F.greatest(F.least(q, F.lit(1.0)), F.lit(0.0))).alias("open")
    )
    return let(
        bounds,
        lambda x: F.when(
            x["u"] * (x["up"] + x["down"]) < x["down"],
            F.when(
                1 - a["p"] <= b["p"] * x["ratio"],
                pair(a, 1.0, b, b["p"] - (1 - a["p"]) / x["ratio"]),
            ).otherwise(pair(b, 0.0, a, a["p"] + b["p"] * x["ratio"])),
        ).otherwise(
            F.when(
                a["p"] <= (1 - b["p"]) * x["ratio"],
                pair(a, 0.0, b, b["p"] + a["p"] / x["ratio"]),
            ).otherwise(pair(b, 1.0, a, a["p"] - (1 - b["p"]) * x["ratio"]))
        ),
    )


def _folded(rows: Column, seed: int) -> Column:
    """Fold sorted rows: an array whose last element is the residual, the others are decided."""
    return F.aggregate(
        F.slice(rows, F.lit(2), F.size(rows)),
        F.slice(rows, 1, 1),
        lambda done, row: let(
            _meet(F.element_at(done, -1), row, seed),
            lambda x: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(x["done"], x["open"])),
        ),
    )


def round_fractions(fractions: DataFrame, seed: int = 42, fan_in: int = FAN_IN) -> DataFrame:
    """``unit`` and ``extra`` (0 or 1) for rows ``source, unit, size, p`` with size above 0."""
    total = fractions.count()
    levels = max(1, math.ceil(math.log(max(total, 2), fan_in)))
    spread = F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(fan_in**levels))
    open_rows, decided = fractions.withColumn("place", spread), []
    for _ in range(levels):
        open_rows = open_rows.withColumn("place", F.floor(F.col("place") / fan_in).cast("long"))
        folded = written(
            open_rows.groupBy("source", "place")
            .agg(F.sort_array(F.collect_list(F.struct("unit", "size", "p"))).alias("rows"))
            .select("source", "place", _folded(F.col("rows"), seed).alias("rows")),
            "mixing",
        )
        decided.append(
            folded.select(F.explode(F.slice("rows", F.lit(1), F.size("rows") - 1)).alias("row"))
        )
        last = F.element_at("rows", -1)
        open_rows = folded.select(
            "source", "place", *[last[c].alias(c) for c in ("unit", "size", "p")]
        )
    result = open_rows.select(
        "unit", (_uniform(F.lit(seed), F.lit("last"), "unit") < F.col("p")).cast("int").alias("extra")
    )
    for frame in decided:
        result = result.unionByName(
            frame.select(F.col("row.unit").alias("unit"), F.col("row.p").cast("int").alias("extra"))
        )
    return result


def _size() -> Column:
    return F.size(words_of(F.col("text"))).cast("long")


def _unit(size: Column) -> Column:
    """A text that tells units apart and is never null."""
    return F.to_json(F.struct("doc_id", "source", size.alias("size")))


def _sized(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", _size().alias("size"))


def mixed_units(sized: DataFrame, seed: int = 42, **targets) -> DataFrame:
    """Per unit ``doc_id, source, size, rows, source_size, target, copies, unit``.

    ``rows`` is the number of equal rows, ``copies`` how many copies they get together.
    """
    units = (
        sized.groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("rows"))
        .withColumn("unit", _unit(F.col("size")))
    )
    goal = source_targets(sized, **targets)
    wanted = F.when(
        F.col("source_size") > 0, F.col("rows") * F.col("target") / F.col("source_size")
    ).otherwise(F.lit(0.0))
    planned = written(
        units.alias("u")
        .join(goal.alias("g"), F.col("u.source").eqNullSafe(F.col("g.source")))
        .select("u.*", "g.source_size", "g.target", wanted.alias("wanted"))
        .withColumn("sure", F.floor("wanted"))
        .withColumn("p", F.col("wanted") - F.col("sure")),
        "mixing",
    )
    extra = round_fractions(
        planned.where("p > 0 and size > 0").select(
            "source", "unit", F.col("size").cast("double").alias("size"), "p"
        ),
        seed,
    )
    alone = (_uniform(F.lit(seed), F.lit("alone"), "unit") < F.col("p")).cast("int")
    return (
        planned.join(extra, "unit", "left")
        .withColumn(
            "copies",
            (F.col("sure") + F.coalesce("extra", F.when(F.col("size") == 0, alone), F.lit(0))).cast("long"),
        )
        .select("doc_id", "source", "size", "rows", "source_size", "target", "copies", "unit")
    )


def _of_row(copies: Column, rows: Column, index: Column) -> Column:
    """Share of the ``index``-th (from 0) of equal rows."""
    return F.floor(copies / rows) + (index < copies % rows).cast("long")


def mix_report(documents: DataFrame, seed: int = 42, **targets) -> DataFrame:
    """One row for each document: ``doc_id, size, source_size, target, copies, taken``."""
    units = mixed_units(written(_sized(documents), "mixing"), seed, **targets)
    each = units.withColumn("index", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    return each.withColumn("copies", _of_row(F.col("copies"), F.col("rows"), F.col("index"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def mix(documents: DataFrame, seed: int = 42, **targets) -> DataFrame:
    """The mixed corpus: every document as often as it was drawn, with the columns it came with."""
    units = mixed_units(written(_sized(documents), "mixing"), seed, **targets)
    unit, rows, copies, index, share, copy = unused(
        documents.columns, "mix_unit", "mix_rows", "mix_copies", "mix_index", "mix_share", "mix_copy"
    )
    drawn = units.where("copies > 0").select(
        F.col("unit").alias(unit), F.col("rows").alias(rows), F.col("copies").alias(copies)
    )
    order = Window.partitionBy(unit).orderBy(F.xxhash64("text"))
    return (
        documents.withColumn(unit, _unit(_size()))
        .withColumn(index, F.row_number().over(order) - 1)
        .join(drawn, unit)
        .withColumn(share, _of_row(F.col(copies), F.col(rows), F.col(index)))
        .where(F.col(share) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(share))))
        .select(*documents.columns)
    )
