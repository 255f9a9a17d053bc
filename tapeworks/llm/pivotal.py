"""Mixing sources to target weights by pivotal dependent rounding in a distributed tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import as_id, id_or_none, keep, whole_text

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
LEAF = 2_000
FAN_IN = 256
SALTS = 16
_NODE = "_name string, node long, _id long, size long, mass double, tie long, copies long, open boolean"


def word_count(column: str = "text"):
    """Words are runs of anything but the six ASCII blanks."""
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by code point of the name, null last; names are spread over tasks by range."""
    spread = sources.repartitionByRange(F.col("_name").asc_nulls_last()).sortWithinPartitions(F.col("_name").asc_nulls_last())
    placed = keep(spread.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    upto = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("m")).select("part", upto.alias("start"))
    rank = F.col("start") + F.col("_row").bitwiseAND(2**33 - 1)
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("_name", "words", "docs", (rank % 3 + 1).alias("weight"))


def source_targets(sized: DataFrame) -> DataFrame:
    """_name, words, docs, weight and target of each source.

    Targets share the words of all sources by weight. One above CAP times its source's words stays there and the excess
    is shared again by weight among the others, until none is above: one small aggregate a round, and every round caps
    another source.
    """
    sources = keep(_ranked(sized.groupBy("_name").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))))
    level = 0.0
    while True:
        capped = F.col("weight") * level >= CAP * F.col("words") if level else F.lit(False)
        got = sources.agg(
            F.coalesce(F.sum("words"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(capped, CAP * F.col("words"))), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        raised = (got["all"] - got["fixed"]) / got["weights"] if got["weights"] else level
        if raised <= level:
            break
        level = raised
    target = F.least(CAP * F.col("words").cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def _uniform(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Repeatable numbers in (0, 1) from two columns of integers."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + other.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _round_node(group: pd.DataFrame) -> pd.DataFrame:
    """Pair the open rows one after the other; each pair moves words until one is whole, and one row at most stays open.

    ``mass`` is a row's fractional words, between 0 and its size. Of a pair with masses a, b either the first gives or
    the second gives, with chances that keep both expectations; the sum of masses never changes. Large rows come first,
    so that the one left open tends to be small.
    """
    group = group.sort_values(["size", "tie", "_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    size, mass = group["size"].to_numpy(), group["mass"].to_numpy().copy()
    chance = _uniform(group["_id"].to_numpy(), group["tie"].to_numpy())
    extra = np.zeros(len(group), dtype=np.int64)
    whole = np.ones(len(group), dtype=bool)
    hold = -1
    for i in range(len(group)):
        if hold < 0:
            hold = i
            continue
        first, second = hold, i
        up = min(size[first] - mass[first], mass[second])
        down = min(mass[first], size[second] - mass[second])
        if chance[second] * (up + down) < down:
            mass[first] += up
            mass[second] -= up
        else:
            mass[first] -= down
            mass[second] += down
        hold = -1
        for k in (first, second):
            if 1e-9 * size[k] < mass[k] < (1 - 1e-9) * size[k]:
                hold = k
            else:
                extra[k] = mass[k] > 0.5 * size[k]
    if hold >= 0:
        whole[hold] = False
    group["mass"], group["copies"], group["open"] = mass, group["copies"].to_numpy() + extra, ~whole
    return group[["_name", "node", "_id", "size", "mass", "tie", "copies", "open"]]


def _planned(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    base = docs.select(
        id_or_none().alias("_id"), F.col("source").cast("string").alias("_name"), word_count().alias("size"), whole_text().alias("_t"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    ).withColumn("tie", F.xxhash64("_t", "_name")).drop("_t")
    facts = keep(base.select("_id", "_name", "size", "tie"))
    sources = keep(source_targets(facts))
    rate = F.when(F.col("words") > 0, F.least(F.lit(float(CAP)), F.col("target") / F.col("words"))).otherwise(F.lit(0.0))
    wide = sources.select(
        F.col("_name").alias("_source"), "words", "target", rate.alias("rate"), F.ceil(F.col("docs") / LEAF).alias("leaves"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"),
    )
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64("_id", "tie"), F.lit(SALTS)).cast("int"))
    known = salted.join(wide, salted["_name"].eqNullSafe(wide["_source"]) & (salted["_salt"] == wide["_part"])).drop("_source", "_salt", "_part")
    leaves = known.filter(F.col("size") > 0).select(
        "_name", F.pmod(F.xxhash64(F.lit(7), "_id", "tie"), F.col("leaves")).alias("node"), "_id", "size",
        ((F.col("rate") - F.floor("rate")) * F.col("size")).alias("mass"), "tie", F.floor("rate").cast("long").alias("copies"), F.lit(True).alias("open"),
    )
    step = keep(leaves.groupBy("_name", "node").applyInPandas(_round_node, _NODE))
    settled = [step.filter(~F.col("open"))]
    left = step.filter("open")
    while (left.agg(F.max("node").alias("node")).first()["node"] or 0) > 0:
        step = keep(left.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("_name", "node").applyInPandas(_round_node, _NODE))
        settled.append(step.filter(~F.col("open")))
        left = step.filter("open")
    draw = F.pmod(F.xxhash64(F.lit(11), "_id", "tie"), F.lit(1 << 30)) / float(1 << 30)
    result = left.withColumn("copies", F.col("copies") + (draw * F.col("size") < F.col("mass")).cast("long"))
    for part in settled:
        result = result.unionByName(part)
    chosen = result.groupBy("_id", "tie").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("plan"))
    plans = known.groupBy("_id", "tie").agg(F.first("words").alias("words"), F.first("target").alias("target")).join(chosen, ["_id", "tie"], "left")
    nth = F.row_number().over(Window.partitionBy("_id", "tie").orderBy("size"))
    rows = (base if carry else facts).join(plans, ["_id", "tie"]).withColumn("_nth", nth - 1)
    return rows.withColumn("copies", F.when(F.col("size") > 0, F.get("plan", "_nth")).otherwise(F.lit(1)))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken: how often the mix takes each document.

    A document's size is its number of words, 0 for a null or blank text. Every document of a source starts from the same
    expected copies, target over the source's words, at most CAP. The whole part is taken at once; the fractions are
    rounded by pivotal sampling in words, so a source's taken words miss its target by one document's size at most,
    no document is taken more than CAP times, and each is taken as often as expected on average. Documents without
    words are taken once, with 0 words. Ties are broken by a repeatable hash, so reruns agree; repeated rows are rounded
    one by one; a null source is a source of its own, after all others; an empty table gives no row; other columns are
    ignored.

    Leaves hold about LEAF documents of one source, split by hash however large the source; the one residual of each
    goes up a tree of FAN_IN children a node until one is left, which is rounded by its own chance.
    """
    return _planned(docs, ()).select(
        as_id("_id").alias("doc_id"), "size", F.col("words").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as ``mix`` takes it, with the columns it came with."""
    names = docs.columns
    taken = _planned(docs, tuple(names)).filter(F.col("copies") > 0).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
