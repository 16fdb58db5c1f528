"""Who eats what: examples whose label needs two namespaces at once, from numbers that each row hashes for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(n: int, *salt: object) -> Column:
    return F.pmod(F.xxhash64("id", *[F.lit(str(s)) for s in salt]), F.lit(n)).cast("int")


def eats(spark: SparkSession, rows: int, hard: bool = False, ids: int = 1000, foods: int | None = None, beyond: int = 250, noise: int = 10, seed: int = 1) -> DataFrame:
    """example_num, label, animal, food, feat_0 ... of `rows` rows. Easy rows have an id up to `beyond` on one side at least; hard ones on neither."""
    foods = foods or ids
    base = spark.range(1, rows + 1).select("id")
    herbivore, plant = _pick(2, seed, "animal") == 0, _pick(2, seed, "food") == 0
    low_side = _pick(2, seed, "side") == 0
    high = lambda n, s: F.lit(beyond + 1) + _pick(n - beyond, seed, s)
    low = lambda s: _pick(beyond + 1, seed, s)
    if hard:
        animal, food = high(ids, "a"), high(foods, "b")
    else:
        animal = F.when(low_side, low("a")).otherwise(_pick(ids, seed, "a2"))
        food = F.when(low_side, _pick(foods, seed, "b2")).otherwise(low("b"))
    out = base.select(
        F.col("id").alias("example_num"),
        F.when(herbivore == plant, 1).otherwise(0).alias("label"),
        F.concat(F.when(herbivore, "Herbivore-").otherwise("Carnivore-"), animal).alias("animal"),
        F.concat(F.when(plant, "Plant-").otherwise("Meat-"), food).alias("food"),
        *[F.concat(F.lit(f"f{i}-"), _pick(10_000, seed, "noise", i)).alias(f"feat_{i}") for i in range(noise)],
    )
    return out


def as_lines(rows: DataFrame) -> DataFrame:
    """example_num, line of rows of eats(): namespaces A, B, and C on for noise."""
    noise = [c for c in rows.columns if c.startswith("feat_")]
    parts = [F.when(F.col("label") == 1, "1").otherwise("-1"), F.concat(F.lit("|A "), "animal"), F.concat(F.lit("|B "), "food")]
    parts += [F.concat(F.lit(f"|{chr(ord('C') + i)} "), c) for i, c in enumerate(noise)]
    return rows.select("example_num", F.concat_ws(" ", *parts).alias("line"))
