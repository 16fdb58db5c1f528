"""Scoring as joins and aggregations over weight tables, which Catalyst plans.

Weight tables are sparse: a weight that isn't there is zero. They are joined as they
come; the session's broadcast threshold decides, by their size, whether they travel.
Sums are in double precision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import prediction
from ..plans.spec import ModelSpec
from .features import long_ffm, long_lr


def lr_sums(features: DataFrame, weights: DataFrame, key: str = "example_num") -> DataFrame:
    """key, combo, s: the sum of weight times value of each combination. weights: idx, w."""
    rows = long_lr(features, key).join(weights.select("idx", F.col("w").cast("double").alias("w")), "idx", "left")
    return rows.groupBy(key, "combo").agg(F.sum(F.col("v") * F.coalesce("w", F.lit(0.0))).alias("s"))


def embeddings(features: DataFrame, weights: DataFrame, n_fields: int, k: int, key: str = "example_num") -> DataFrame:
    """key, i, f, v, z, j, w: each feature's k numbers towards each field z."""
    rows = long_ffm(features, key).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_fields * k - 1))).alias("at"))
    rows = rows.select(key, "i", "f", "v", F.floor(F.col("at") / k).cast("int").alias("z"), (F.col("at") % k).alias("j"), (F.col("h") + F.col("at")).alias("idx"))
    return rows.join(weights.select("idx", F.col("w").cast("double").alias("w")), "idx", "left").select(key, "i", "f", "v", "z", "j", F.coalesce("w", F.lit(0.0)).alias("w"))


def field_vectors(emb: DataFrame, key: str = "example_num") -> DataFrame:
    """key, f, z, j, c, s: sums of each field's features towards each other one, and of their squares. Pairs of features never meet: sums of fields do."""
    return emb.groupBy(key, "f", "z", "j").agg(F.sum(F.col("v") * F.col("w")).alias("c"), F.sum(F.col("v") * F.col("v") * F.col("w") * F.col("w")).alias("s"))


def field_outputs(vectors: DataFrame, key: str = "example_num") -> DataFrame:
    """key, f1, f2 (f1 <= f2), o: the field interactions, a pair's two halves added up; on the diagonal a field's pairs of different features.

    Both directions of a pair of fields, and the diagonal, fall to one key: no self-join.
    """
    lo, hi = F.least("f", "z").alias("f1"), F.greatest("f", "z").alias("f2")
    pairs = vectors.groupBy(key, lo, hi, "j").agg(F.sum(F.when(F.col("f") < F.col("z"), F.col("c"))).alias("a"), F.sum(F.when(F.col("f") > F.col("z"), F.col("c"))).alias("b"), F.sum(F.when(F.col("f") == F.col("z"), 0.5 * (F.col("c") * F.col("c") - F.col("s")))).alias("d"))
    return pairs.groupBy(key, "f1", "f2").agg(F.sum(F.when(F.col("f1") == F.col("f2"), F.col("d")).otherwise(F.coalesce(F.col("a") * F.col("b"), F.lit(0.0)))).alias("o"))


def totals(features: DataFrame, spec: ModelSpec, lr_weights: DataFrame, ffm_weights: DataFrame | None = None, key: str = "example_num") -> DataFrame:
    """key, total: linear and field sums of each example; 0 for one without features.

    Examples are dealt by key while they are compact, so that what they explode to
    is aggregated in place, where weights are small enough to come to them.
    """
    features = features.repartition(key)
    linear = long_lr(features, key, empty=True).join(lr_weights.select("idx", F.col("w").cast("double").alias("w")), "idx", "left")
    sums = linear.groupBy(key).agg(F.sum(F.coalesce(F.col("v") * F.col("w"), F.lit(0.0))).alias("total"))
    if not spec.ffm_k or ffm_weights is None:
        return sums
    outputs = field_outputs(field_vectors(embeddings(features, ffm_weights, spec.n_fields, spec.ffm_k, key), key), key)
    return sums.union(outputs.select(key, "o")).groupBy(key).agg(F.sum("total").alias("total"))


def score(features: DataFrame, spec: ModelSpec, lr_weights: DataFrame, ffm_weights: DataFrame | None = None, key: str = "example_num") -> DataFrame:
    """key, total, prediction."""
    return totals(features, spec, lr_weights, ffm_weights, key).select(key, "total", prediction(F.col("total")).alias("prediction"))


def inputs_vector(features: DataFrame, spec: ModelSpec, lr_weights: DataFrame, ffm_weights: DataFrame | None = None, key: str = "example_num") -> DataFrame:
    """key, x: the dense input of a net: sums of combinations, then the lower triangle of field interactions row by row."""
    parts = lr_sums(features, lr_weights, key).select(key, F.col("combo").alias("at"), F.col("s").alias("x"))
    width = spec.n_combos
    if spec.ffm_k and ffm_weights is not None:
        out = field_outputs(field_vectors(embeddings(features, ffm_weights, spec.n_fields, spec.ffm_k, key), key), key)
        place = F.lit(width) + F.floor(F.col("f2") * (F.col("f2") + 1) / 2) + F.col("f1")
        parts = parts.union(out.select(key, place.cast("int").alias("at"), F.col("o").alias("x")))
        width += spec.n_fields * (spec.n_fields + 1) // 2
    none = features.select(key, F.lit(0).alias("at"), F.lit(0.0).alias("x"))  # examples without features stay
    sums = [F.coalesce(F.sum(F.when(F.col("at") == i, F.col("x"))), F.lit(0.0)) for i in range(width)]
    return parts.union(none).groupBy(key).agg(F.array(*sums).alias("x"))


def triangle(square: Sequence[Sequence[Column]]) -> list[Column]:
    """The lower triangle row by row of a square of halves: off the diagonal both halves."""
    return [square[i][j] * 2 if j < i else square[i][i] for i in range(len(square)) for j in range(i + 1)]


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def normalize(x: Column, learning: bool = False) -> Column:
    """Scaled by a spread; the mean is taken off while learning only."""
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n

    def by(m: Column) -> Column:
        spread = F.aggregate(x, F.lit(0.0), lambda a, v: a + (m * m - v) * (m * m - v))
        return F.transform(x, lambda v: (v - (m if learning else F.lit(0.0))) / F.sqrt((spread + 1e-2) / n))

    return F.element_at(F.transform(F.array(mean), by), 1)


def dense(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """A layer of neurons: weights a row for each neuron."""
    rows = []
    for w, b in zip(weights, bias, strict=True):
        products = F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, c: a * c)
        rows.append(F.aggregate(products, F.lit(float(b)), lambda s, p: s + p))
    return F.array(*rows)


def net_total(x: Column, spec: ModelSpec, layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]], learning: bool = False) -> Column:
    """A net's sum from its input vector. layers: weights and biases of each layer, the final neuron's last."""
    h = normalize(x, learning) if spec.topology == "four" else x
    for layer, (w, b) in zip(spec.layers, layers[:-1], strict=True):
        h = dense(h, w, b)
        if layer.layernorm == "before":
            h = normalize(h, learning)
        if layer.activation == "relu":
            h = relu(h)
        if layer.layernorm == "after":
            h = normalize(h, learning)
    if spec.topology != "two":
        h = F.concat(h, x)
    return F.element_at(dense(h, *layers[-1]), 1)


def context_fields(context: DataFrame, spec: ModelSpec, ffm_weights: DataFrame) -> DataFrame:
    """ctx, towards: a context's field sums as one array, that of field z towards field f at (z * fields + f) * k."""
    vectors = field_vectors(embeddings(context, ffm_weights, spec.n_fields, spec.ffm_k, "ctx"), "ctx")
    place = ((F.col("f") * spec.n_fields + F.col("z")) * spec.ffm_k + F.col("j")).cast("int")
    sums = vectors.groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct(place, "c"))).alias("c"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(spec.n_fields**2 * spec.ffm_k - 1)), lambda i: F.coalesce(F.try_element_at("c", i), F.lit(0.0)))
    return sums.select("ctx", dense.alias("towards"))


def score_with_context(context: DataFrame, candidates: DataFrame, spec: ModelSpec, lr_weights: DataFrame, ffm_weights: DataFrame | None = None) -> DataFrame:
    """ctx, example_num, total, prediction of candidates that share contexts. context: ctx, lr, ffm; candidates: ctx, example_num, lr, ffm.

    A context's own total and field sums are computed once. A candidate's own total
    is that of its few features; what it and its context have in common is linear in
    the candidate's features: each one's numbers, times the context's sums towards
    its field, which come as one array beside the candidate.
    """
    shared = totals(context, spec, lr_weights, ffm_weights, "ctx").withColumnRenamed("total", "y")
    rows = candidates.join(shared, "ctx", "left")
    fields = spec.ffm_k and ffm_weights is not None
    if fields:
        rows = rows.join(context_fields(context, spec, ffm_weights), "ctx", "left")
    rows = rows.repartition("example_num")  # what it explodes to is aggregated in place
    linear = rows.select("ctx", "example_num", "y", F.explode_outer("lr").alias("x")).select("ctx", "example_num", "y", F.col("x.hash").alias("idx"), F.col("x.value").cast("double").alias("v"))
    linear = linear.join(lr_weights.select("idx", F.col("w").cast("double").alias("w")), "idx", "left").groupBy("example_num").agg(F.first("ctx").alias("ctx"), (F.coalesce(F.first("y"), F.lit(0.0)) + F.sum(F.coalesce(F.col("v") * F.col("w"), F.lit(0.0)))).alias("total"))
    if not fields:
        return linear.select("ctx", "example_num", "total", prediction(F.col("total")).alias("prediction"))
    n, k = spec.n_fields, spec.ffm_k
    each = rows.select("example_num", "towards", F.posexplode_outer("ffm").alias("i", "x")).where(F.col("x").isNotNull())
    each = each.select("example_num", F.col("x.field").alias("f"), F.col("x.hash").alias("h"), F.col("x.value").cast("double").alias("v"), "towards", F.explode(F.sequence(F.lit(0), F.lit(n * k - 1))).alias("at"))
    z, j = F.floor(F.col("at") / k).cast("int"), F.col("at") % k
    each = each.select("example_num", "f", z.alias("z"), j.alias("j"), "v", (F.col("h") + F.col("at")).alias("idx"), F.coalesce(F.get("towards", (z * n + F.col("f")) * k + j), F.lit(0.0)).alias("other"))
    each = each.join(ffm_weights.select("idx", F.col("w").cast("double").alias("w")), "idx", "left").withColumn("own", F.col("v") * F.coalesce("w", F.lit(0.0)))
    vectors = each.groupBy("example_num", "f", "z", "j").agg(F.sum("own").alias("c"), F.sum(F.col("own") * F.col("own")).alias("s"), F.sum(F.col("own") * F.col("other")).alias("common"))
    lo, hi = F.least("f", "z").alias("f1"), F.greatest("f", "z").alias("f2")
    c = lambda which: F.sum(F.when(which, F.col("c")))
    pairs = vectors.groupBy("example_num", lo, hi, "j").agg(c(F.col("f") < F.col("z")).alias("a"), c(F.col("f") > F.col("z")).alias("b"), F.sum(F.when(F.col("f") == F.col("z"), 0.5 * (F.col("c") * F.col("c") - F.col("s")))).alias("d"), F.sum("common").alias("common"))
    own = F.when(F.col("f1") == F.col("f2"), F.col("d")).otherwise(F.coalesce(F.col("a") * F.col("b"), F.lit(0.0)))
    sums = pairs.select("example_num", F.lit(None).cast(linear.schema["ctx"].dataType).alias("ctx"), (own + F.col("common")).alias("total"))
    both = linear.select("example_num", "ctx", "total").union(sums)
    out = both.groupBy("example_num").agg(F.max("ctx").alias("ctx"), F.sum("total").alias("total"))
    return out.select("ctx", "example_num", "total", prediction(F.col("total")).alias("prediction"))
