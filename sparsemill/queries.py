"""A query for each operator of the feature engine, over the driver's tables.

Examples are orders with their customers: three categorical namespaces (priority,
segment, nation), two float ones (price, balance), and the flags of an order's
lines as a namespace of many values. Weights are closed forms of their place, so
that any engine can make the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import ffm_mask, int_hash, lr_mask, namespace_seed, token_hash
from .functions.losses import gradient, prediction, prediction_line
from .operators import learn, metrics, score, weights
from .operators.features import featurize, long_ffm, long_lr
from .plans.spec import ModelSpec, from_args
from .sources import cache, model_store, sql, text
from .sources.catalog import Catalog
from .storage import shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]

CATALOG = Catalog.from_rows([("A", "priority"), ("B", "segment"), ("C", "nation"), ("D", "price", "f32"), ("E", "balance", "f32"), ("G", "flags")])
SCORE = "--keep A --keep B:1.5 --interactions AB --interactions ABC:2 --linear segment,nation"
FIELDS = "--ffm_k 2 --ffm_field A --ffm_field B --ffm_field CG"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ex, label, a, b, c, price, bal."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("ex"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.replace("o_orderpriority", F.lit(" "), F.lit("_")).alias("a"),
        F.replace("c_mktsegment", F.lit(" "), F.lit("_")).alias("b"),
        F.col("c_nationkey").cast("string").alias("c"),
        F.col("o_totalprice").cast("float").alias("price"),
        F.col("c_acctbal").cast("float").alias("bal"),
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ex, g: the return flags of an order's lines, sorted, duplicates kept."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ex")).agg(F.array_sort(F.collect_list("l_returnflag")).alias("g"))


def examples(spark: SparkSession, sf_dir: str, with_flags: bool = False) -> DataFrame:
    rows = base(spark, sf_dir)
    namespaces = {"A": F.col("a"), "B": F.col("b"), "C": F.col("c"), "D": F.col("price"), "E": F.col("bal")}
    if with_flags:
        rows = rows.join(flags(spark, sf_dir), "ex", "left")
        namespaces["G"] = F.coalesce("g", F.array().cast("array<string>"))
    out = text.from_table(rows, "ex", F.col("label"), namespaces, CATALOG)
    return out if with_flags else out.withColumn("ns_G", F.array().cast(text.FEATURES))


def lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    return text.parse(base(spark, sf_dir).select(F.col("ex").alias("example_num"), line.alias("line")), CATALOG)


def spec(args: str) -> ModelSpec:
    return from_args(args, CATALOG)


def featured(spark: SparkSession, sf_dir: str, args: str, with_flags: bool = False) -> DataFrame:
    return featurize(examples(spark, sf_dir, with_flags), spec(args))


def closed_form(idx: Column, scale: float = 1000.0) -> Column:
    return ((idx * 7919) % 1000 - 500) / scale


def lr_weights(spark: SparkSession, bits: int = 18) -> DataFrame:
    return spark.range(1 << bits).select(F.col("id").alias("idx"), closed_form(F.col("id")).alias("w"), F.lit(0.0).alias("acc"))


def ffm_weights(spark: SparkSession, n_fields: int = 3, k: int = 2, bits: int = 18) -> DataFrame:
    return spark.range((1 << bits) + n_fields * k).select(F.col("id").alias("idx"), closed_form(F.col("id")).alias("w"))


def r6(c: Column | str) -> Column:
    """Six decimals, no negative zero."""
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), 6) + F.lit(0.0)


def exploded(rows: DataFrame, column: str, value: str = "weight") -> DataFrame:
    """ex, pos, hash, value of a namespace's column."""
    x = rows.select(F.col("example_num").alias("ex"), F.posexplode(column).alias("pos", "x"))
    v = F.col(f"x.{value}")
    return x.select("ex", "pos", F.col("x.hash").alias("hash"), F.when(~F.isnan(v), F.round(v.cast("double"), 4)).alias("v"))


def linear_rows(spark: SparkSession, sf_dir: str, args: str, with_flags: bool = False) -> DataFrame:
    """ex, combo, idx, v of a specification."""
    return long_lr(featured(spark, sf_dir, args, with_flags)).select(F.col("example_num").alias("ex"), "combo", "idx", F.round("v", 4).alias("v"))


# Text and hashing


def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 stands for no label."""
    given = F.when(F.col("ex") % 3 == 0, "1 ").when(F.col("ex") % 3 == 1, "-1 ").otherwise("")
    return lines(spark, sf_dir, F.concat(given, F.lit("|A "), "a")).select(F.col("example_num").alias("ex"), F.coalesce("label", F.lit(-1)).alias("label"))


def importance_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("1 "), F.when(F.col("ex") % 4 == 0, "").when(F.col("ex") % 4 == 1, "0.5 ").when(F.col("ex") % 4 == 2, "-2 ").otherwise("x "), F.lit("|A "), "a")
    return lines(spark, sf_dir, line).select(F.col("example_num").alias("ex"), r6("importance").alias("importance"), "error")


def feature_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(lines(spark, sf_dir, F.concat(F.lit("1 |A "), "a", F.lit(" "), "b", F.lit(":0.5  "), "c")), "ns_A")


def namespace_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(lines(spark, sf_dir, F.concat(F.lit("1 |B:2 "), "b", F.lit(":3 "), "a")), "ns_B")


def f32_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(lines(spark, sf_dir, F.concat(F.lit("1 |D "), (F.col("ex") % 100).cast("string"), F.lit(".25 NONE"))), "ns_D", "fval")


def command_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("ex") % 5 == 0, "flush").when(F.col("ex") % 5 == 1, F.concat(F.lit("hogwild_load /m/"), "a")).otherwise(F.concat(F.lit("1 |A "), "a"))
    return lines(spark, sf_dir, line).where("command is not null").groupBy("command", "argument").agg(F.count("*").alias("n"))


def ns_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = base(spark, sf_dir).select(F.element_at(F.array(*map(F.lit, "ABCDEGZ")), (F.col("ex") % 7 + 1).cast("int")).alias("name"))
    return names.join(F.broadcast(CATALOG.table(spark)), "name").groupBy("name", "ns_index", "seed").agg(F.count("*").alias("n"))


def undeclared_ns_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("1 |"), F.when(F.col("ex") % 3 == 0, F.concat(F.lit("Z"), "c")).otherwise("A"), F.lit(" x"))
    return lines(spark, sf_dir, line).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def multi_value_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(examples(spark, sf_dir, True), "ns_G")


def token_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("token")).distinct()
    return names.select("token", F.element_at(token_hash(F.array("token"), namespace_seed("A")), 1).alias("hash"))


def int_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", int_hash(123, F.col("p_partkey").cast("int")).alias("hash"))


def int_pair_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", int_hash(7, F.col("p_partkey").cast("int"), F.col("p_size")).alias("hash"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") * 7919
    return table(spark, sf_dir, "orders").select("o_orderkey", key.bitwiseAND(F.lit(lr_mask(18))).alias("lr_idx"), key.bitwiseAND(F.lit(ffm_mask(18, 3))).alias("ffm_idx"))


# Feature construction


def _features(args: str, with_flags: bool = False) -> Query:
    return lambda spark, sf_dir: linear_rows(spark, sf_dir, args, with_flags)


def _transformed(statement: str, more: str = "") -> Query:
    """Linear features of one transform named t."""
    return lambda spark, sf_dir: linear_rows(spark, sf_dir, f"--noconstant --linear t --transform t={statement} {more}")


def primitive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field features of primitive namespaces only, as a shared context has them."""
    s = spec("--noconstant --ffm_k 3 --ffm_field_verbose segment,t --transform t=Combine(priority,nation)()")
    s.fields = [tuple(c for c in f if not c.startswith("tx_")) for f in s.fields]
    return _ffm_rows(featurize(examples(spark, sf_dir), s))


def _ffm_rows(features: DataFrame) -> DataFrame:
    return long_ffm(features).select(F.col("example_num").alias("ex"), "i", "f", "h", F.round("v", 4).alias("v"))


def ffm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ffm_rows(featured(spark, sf_dir, "--noconstant --ffm_k 3 --ffm_field AB --ffm_field C --ffm_field G", True))


# Scoring


def lr_combo_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.lr_sums(featured(spark, sf_dir, SCORE), lr_weights(spark)).select(F.col("example_num").alias("ex"), "combo", r6("s").alias("s"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_num, total, prediction, label by linear weights."""
    features = featured(spark, sf_dir, SCORE)
    return score.score(features, spec(SCORE), lr_weights(spark)).join(features.select("example_num", "label", "importance"), "example_num")


def lr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score(featured(spark, sf_dir, SCORE), spec(SCORE), lr_weights(spark)).select(F.col("example_num").alias("ex"), r6("total").alias("total"), r6("prediction").alias("prediction"))


def lr_score_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = lr_weights(spark).select("idx", (F.col("w") * 200).alias("w"))
    return score.score(featured(spark, sf_dir, SCORE), spec(SCORE), big).select(F.col("example_num").alias("ex"), r6("prediction").alias("prediction"))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.embeddings(featured(spark, sf_dir, f"--noconstant {FIELDS}", True), ffm_weights(spark), 3, 2)


def ffm_field_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.field_vectors(_embedded(spark, sf_dir)).select(F.col("example_num").alias("ex"), "f", "z", "j", r6("c").alias("c"))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.field_outputs(score.field_vectors(_embedded(spark, sf_dir))).withColumnRenamed("example_num", "ex")


def ffm_pair_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).where("f1 < f2").select("ex", "f1", "f2", r6("o").alias("o"))


def ffm_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).where("f1 = f2").select("ex", "f1", r6("o").alias("o"))


def triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = score.inputs_vector(featured(spark, sf_dir, f"--noconstant {FIELDS}", True), spec(f"--noconstant {FIELDS}"), lr_weights(spark), ffm_weights(spark))
    return x.select(F.col("example_num").alias("ex"), F.posexplode("x").alias("slot", "v")).select("ex", "slot", r6("v").alias("v"))


def ffm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = f"--noconstant {FIELDS}"
    out = score.score(featured(spark, sf_dir, args, True), spec(args), lr_weights(spark), ffm_weights(spark))
    return out.select(F.col("example_num").alias("ex"), r6("prediction").alias("prediction"))


def lr_plus_ffm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = f"{SCORE} {FIELDS}"
    out = score.score(featured(spark, sf_dir, args, True), spec(args), lr_weights(spark), ffm_weights(spark))
    return out.select(F.col("example_num").alias("ex"), r6("total").alias("total"), r6("prediction").alias("prediction"))


def context_cache_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is a context of all its customers' orders."""
    args = f"--noconstant --keep A --keep C {FIELDS}"
    rows = examples(spark, sf_dir, True)
    nothing = F.array().cast(text.FEATURES)
    shared = base(spark, sf_dir).select(F.col("c").alias("ctx")).distinct()
    context = featurize(text.from_table(shared.withColumn("ex", F.col("ctx").cast("long")), "ex", None, {"C": F.col("ctx")}, CATALOG).withColumns({f"ns_{n}": nothing for n in "ABDEG"}), spec(args)).select(F.col("example_num").alias("ctx"), "lr", "ffm")
    key = base(spark, sf_dir).select(F.col("ex").alias("example_num"), F.col("c").cast("long").alias("ctx"))
    own = featurize(rows.withColumn("ns_C", nothing).join(key, "example_num"), spec(args), keep=("ctx",))
    out = score.score_with_context(context, own, spec(args), lr_weights(spark), ffm_weights(spark))
    return out.select(F.col("example_num").alias("ex"), r6("prediction").alias("prediction"))


# Dense layers, over embeddings


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _elements(rows: DataFrame, x: Column) -> DataFrame:
    return rows.select("vec_id", F.posexplode(x).alias("slot", "v")).select("vec_id", "slot", r6("v").alias("v"))


def relu_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_vectors(spark, sf_dir), score.relu(F.col("x")))


def normalize_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_vectors(spark, sf_dir), score.normalize(F.col("x")))


def normalize_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_vectors(spark, sf_dir), score.normalize(F.col("x"), learning=True))


def sum_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A neuron whose weights are all one."""
    total = F.element_at(score.dense(F.col("x"), [[1.0] * 64], [0.0]), 1)
    return _vectors(spark, sf_dir).where(F.size("x") == 64).select("vec_id", r6(total).alias("total"))


def layer_weights(neurons: int, inputs: int) -> tuple[list[list[float]], list[float]]:
    return [[((n * inputs + i) * 7919 % 1000 - 500) / 1000 for i in range(inputs)] for n in range(neurons)], [(n * 7919 % 1000 - 500) / 1000 for n in range(neurons)]


def nn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight neurons with rectifiers, then one, over 64 inputs and the skipped copy of them."""
    s = spec("--noconstant --nn_layers 1 --nn 0:width:8 --nn 0:activation:relu")
    total = score.net_total(F.col("x"), s, [layer_weights(8, 64), ([[1.0] * 72], [0.0])])
    return _vectors(spark, sf_dir).where(F.size("x") == 64).select("vec_id", r6(prediction(total)).alias("prediction"))


# Learning


def logloss_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(F.col("example_num").alias("ex"), r6(gradient(F.col("total"), F.col("label"), F.col("importance").cast("double"))).alias("g"))


def _gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = featured(spark, sf_dir, SCORE)
    return learn.lr_gradient(features, learn.residuals(features, spec(SCORE), lr_weights(spark)))


def minibatch_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir).select("idx", r6("g").alias("g"), r6("s").alias("s"))


def _step(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = spec(f"{SCORE} -l 0.1 --power_t 0.5")
        grads = _gradients(spark, sf_dir)
        start = lr_weights(spark).withColumn("acc", F.lit(learn.initial_acc(kind, s.lr)))
        moved = learn.apply_gradient(start.join(grads.select("idx"), "idx", "left_semi"), grads, kind, s.lr)
        return moved.select("idx", r6("w").alias("w"), r6("acc").alias("acc"))

    return run


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("example_num", "label", F.round("prediction", 9).alias("prediction"))


def logloss_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_logloss(_labelled(spark, sf_dir)).select(r6("logloss").alias("logloss"))


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.confusion(_labelled(spark, sf_dir))
    return out.select("tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "specificity", "f1", "balanced_accuracy", "logloss")])


def distinct_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_predictions(_labelled(spark, sf_dir).withColumn("prediction", r6("prediction")))


def running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_loss(_labelled(spark, sf_dir)).select(F.col("example_num").alias("ex"), r6("mean_loss").alias("mean_loss"))


IN_ORDER = "--noconstant --keep A --keep B --sgd -l 0.1"


def _in_order(spark: SparkSession, sf_dir: str, importance: Column | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Predictions of a linear model that learns the orders one after the other."""
    rows = featured(spark, sf_dir, IN_ORDER)
    if importance is not None:
        rows = rows.withColumn("importance", importance.cast("float"))
    return learn.sequential(rows, spec(IN_ORDER), **options)[0].select(F.col("example_num").alias("ex"), r6("prediction").alias("prediction"))


def sequential_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, sf_dir)


def predictions_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, sf_dir, predictions_after=1000)


def update_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples from 1000 on are held out, and a tenth of all has no importance: neither change the model."""
    return _in_order(spark, sf_dir, F.when(F.col("example_num") % 10 == 0, 0.0).otherwise(1.0), holdout_after=1000)


def delayed_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, sf_dir, delay=100)


def many_models_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each of eight groups."""
    rows = featured(spark, sf_dir, IN_ORDER).withColumn("model_id", F.col("example_num") % 8)
    out = learn.many_models(rows, spec(IN_ORDER)).where("kind = 'prediction'")
    return out.select("model_id", F.col("example_num").alias("ex"), r6("prediction").alias("prediction"))


def warm_start_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the orders, learned from where the first half left off (weights are stored in single precision)."""
    rows = stored(featured(spark, sf_dir, IN_ORDER), "features")
    half = rows.agg(F.floor(F.max("example_num") / 2)).first()[0]
    first = learn.sequential(rows.where(F.col("example_num") <= half), spec(IN_ORDER))[1]
    out = learn.sequential(rows.where(F.col("example_num") > half), spec(IN_ORDER), first)[0]
    return out.select(F.col("example_num").alias("ex"), F.round("prediction", 4).alias("prediction"))


def prediction_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(F.col("example_num").alias("ex"), "prediction").withColumn("prediction", F.round("prediction", 6)).select("ex", prediction_line().alias("line"))


# Weight tables


def weight_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_acctbal") / 1000).alias("w"))
    return weights.statistics(w).withColumn("mean_w", r6("mean_w"))


def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("float").alias("q"), F.lit(-0.5).cast("float").alias("low"), F.lit(0.25).cast("float").alias("increment"))
    return weights.dequantize(q).select("idx", r6("w").alias("w"))


def _bytes(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    b = (F.col("o_orderkey") * 31 % 256).cast("int")
    if changed:
        b = F.when(F.col("o_orderkey") % 7 == 0, (b + 1) % 256).otherwise(b)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), b.alias("b"))


def weight_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.diff(_bytes(spark, sf_dir, False), _bytes(spark, sf_dir, True))


def weight_diff_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.apply_diff(_bytes(spark, sf_dir, False), weight_diff(spark, sf_dir))


def inference_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = table(spark, sf_dir, "part").select(F.lit("lr").alias("block"), F.col("p_partkey").alias("idx"), closed_form(F.col("p_partkey")).alias("w"), F.lit(1.0).alias("acc"))
    return weights.to_inference(full).select("block", "idx", r6("w").alias("w"))


def model_averaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The averaging step, of four parts of different sizes; a part's untouched weights count as zero."""
    part = (F.col("o_orderkey") % 4).cast("string").alias("part")
    rows = table(spark, sf_dir, "orders").select(part, F.lit("lr").alias("block"), (F.col("o_custkey") % 1000).alias("idx"), closed_form(F.col("o_custkey")).alias("x"), F.lit(0.0).alias("acc"))
    own = rows.groupBy("part", "block", "idx").agg(F.max("x").alias("w"), F.max("acc").alias("acc"))
    counts = spark.createDataFrame([(str(i), i + 1) for i in range(4)], "part string, n long")
    return learn.average(own, counts, spec("--keep A")).select("idx", r6("w").alias("w"))


# Learning, storing and serving


WITH_FIELDS = "--keep A --keep B --interactions AB --ffm_k 2 --ffm_field A --ffm_field B --adaptive -l 0.1 --power_t 0.3 -b {bits} --ffm_bit_precision {bits} --ffm_init_width 0.2"


def _with_fields(spark: SparkSession, sf_dir: str, bits: int = 16) -> tuple[DataFrame, ModelSpec]:
    """All orders, for a model with fields."""
    args = WITH_FIELDS.format(bits=bits)
    return featured(spark, sf_dir, args), spec(args)


def sequential_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, s = _with_fields(spark, sf_dir)
    return learn.sequential(features, s)[0]


def delayed_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, s = _with_fields(spark, sf_dir)
    return learn.sequential(features, s, delay=100)[0]


def warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, s = _with_fields(spark, sf_dir)
    features = stored(features, "features")
    half = features.agg(F.floor(F.max("example_num") / 2)).first()[0]
    _, w = learn.sequential(features.where(F.col("example_num") <= half), s)
    return learn.sequential(features.where(F.col("example_num") > half), s, w)[0]


def many_models_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each of eight groups."""
    features, s = _with_fields(spark, sf_dir, 12)
    out = learn.many_models(features.withColumn("model_id", (F.col("example_num") % 8).cast("string")), s)
    return out.where("kind = 'prediction'").select("model_id", "example_num", "prediction")


def hogwild_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, s = _with_fields(spark, sf_dir)
    return learn.score_local(features, s, learn.averaged(features, s, 4))


def minibatch_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear and field weights after two steps over all orders."""
    args = "--noconstant --keep A --keep B --ffm_k 2 --ffm_field A --ffm_field B -l 0.01 --ffm_bit_precision 12"
    lr, ffm = learn.minibatch(featured(spark, sf_dir, args), spec(args), epochs=2)
    return lr.select(F.lit("lr").alias("block"), "idx", "w").union(ffm.select(F.lit("ffm"), "idx", "w"))


def minibatch_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear weights after two steps over all orders."""
    args = "--noconstant --keep A --keep B --sgd -l 0.001"
    return learn.minibatch(featured(spark, sf_dir, args), spec(args), epochs=2)[0].select("idx", r6("w").alias("w"))


def _saved(spark: SparkSession, sf_dir: str, name: str, scale: float = 1000.0) -> str:
    import uuid

    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = spark.range(1 << 12).select(F.lit("lr").alias("block"), F.col("id").alias("idx"), closed_form(F.col("id"), scale).cast("float").alias("w"), F.lit(0.0).cast("float").alias("acc"))
    model_store.save(spec("--keep A --keep B -b 12"), w, path)
    return path


def model_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, w = model_store.load(spark, _saved(spark, sf_dir, "model"))
    out = learn.score_local(featurize(examples(spark, sf_dir), s), s, w)
    return out.select(F.col("example_num").alias("ex"), F.round("prediction", 4).alias("prediction"))


def sql_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model called from SQL; one line in seven can't be parsed."""
    sql.register(spark, _saved(spark, sf_dir, "model"), "order_model")
    line = F.when(F.col("ex") % 7 == 0, "1 |Z z").otherwise(F.concat(F.lit("1 |A "), "a", F.lit(" |B "), "b"))
    base(spark, sf_dir).select("ex", line.alias("line")).createOrReplaceTempView("order_lines")
    return spark.sql("select ex, round(order_model(line), 4) as prediction from order_lines")


def quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_acctbal") / 1000).alias("w"))
    q = weights.quantize(w)
    return q.join(weights.dequantize(q), "idx").select("idx", F.col("q").cast("long").alias("bucket"), r6("w").alias("w"))


def record_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    cache.write(lines(spark, sf_dir, F.concat(F.lit("1 |A "), "a", F.lit(" |B "), "b")), CATALOG, path)
    if not cache.valid(spark, CATALOG, path):
        raise ValueError("the cache isn't valid")
    return cache.read(spark, path).select(F.col("example_num").alias("ex"), "label", F.size("ns_A").alias("n_a"), F.size("ns_B").alias("n_b"))


def _four(response: str) -> Column:
    """An answer's number at four decimals, to compare with other engines; errors as they are."""
    return F.when(F.col(response).startswith("ERR"), F.col(response)).otherwise(F.format_string("%.4f", F.round(F.col(response).try_cast("double"), 4)))


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file stream, answered by micro-batches; one in seven can't be parsed."""
    import uuid

    from .streaming.serve import Server, serve

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    line = F.when(F.col("ex") % 7 == 0, "1 |Z z").otherwise(F.concat(F.lit("1 |A "), "a", F.lit(" |B "), "b"))
    base(spark, sf_dir).select(F.col("ex").alias("example_num"), line.alias("line")).repartition(4).write.parquet(f"{root}/in")
    source = spark.readStream.schema("example_num long, line string").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    server = Server(spark, _saved(spark, sf_dir, "model"))
    serve(source, server, lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}"), f"{root}/checkpoint", once=True).awaitTermination()
    out = spark.read.schema("example_num long, response string").parquet(f"{root}/out")
    return out.select(F.col("example_num").alias("ex"), _four("response").alias("response"))


def hot_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines before and after another model's weights replace the first one's."""
    from .streaming.serve import Server

    server = Server(spark, _saved(spark, sf_dir, "model"))
    rows = base(spark, sf_dir).select(F.col("ex").alias("example_num"), F.concat(F.lit("1 |A "), "a").alias("line"))
    before = server.answer(rows).withColumnRenamed("response", "before")
    command = spark.createDataFrame([(0, f"hogwild_load {_saved(spark, sf_dir, 'model', 500.0)}")], "example_num long, line string")
    answer = server.answer(command).collect()[0].response
    both = before.join(server.answer(rows).withColumnRenamed("response", "after"), "example_num")
    return both.select(F.col("example_num").alias("ex"), _four("before").alias("before"), _four("after").alias("after"), F.lit(answer).alias("answer"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.serve import event_windows as windows

    return windows(table(spark, sf_dir, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "keep_features": _features("--keep A --keep B"),
        "weighted_keep": _features("--noconstant --keep A:1.5 --keep G:2", True),
        "linear_terms": _features("--noconstant --linear priority:2 --linear segment,nation:0.5"),
        "constant_feature": _features(""),
        "missing_namespace": _features("--noconstant --keep G --interactions AG --keep A"),
        "fnv_pair": _features("--noconstant --interactions AB"),
        "fnv_triple": _features("--noconstant --interactions ABC:2"),
        "multi_value_interaction": _features("--noconstant --interactions AG", True),
        "float_as_category": _features("--noconstant --keep E"),
        "binner_sqrt_plain": _transformed("BinnerSqrtPlain(price)(1000,2)"),
        "binner_sqrt_interp": _transformed("BinnerSqrt(price)(1000,1)"),
        "binner_log_plain": _transformed("BinnerLogPlain(price)(0,10)"),
        "binner_log_interp": _transformed("BinnerLog(price)(0,1)"),
        "logratio_plain": _transformed("BinnerLogRatioPlain(price,balance)(10,100)"),
        "logratio_interp": _transformed("BinnerLogRatio(price,balance)(10,1)"),
        "combine2": _transformed("Combine(priority,segment)()"),
        "combine3": _transformed("Combine(priority,segment,nation)()"),
        "combine4": _transformed("Combine(priority,segment,nation,balance)()"),
        "weight_transform": _transformed("Weight(priority)(2.5)"),
        "nested_transform": _transformed("Combine(u,nation)()", "--transform u=Weight(segment)(2)"),
        "sgd_step": _step("sgd"),
        "adagrad_flex_step": _step("adagrad_flex"),
        "adagrad_lut_step": _step("adagrad_lut"),
    }
    plain = (lr_plus_ffm_score, label_parse, importance_parse, feature_tokenise, namespace_weight, f32_value_parse, command_filter, ns_lookup, undeclared_ns_anti, multi_value_namespace, token_hashes, int_hashes, int_pair_hashes, masks, primitive_filter, ffm_features, lr_combo_sums, lr_score, lr_score_clamped, ffm_field_vectors, ffm_pair_dot, ffm_diagonal, triangle, ffm_score, context_cache_score, relu_layer, normalize_predict, normalize_learn, sum_block, nn_forward, logloss_gradient, minibatch_gradient, logloss_metric, confusion_metrics, distinct_predictions, running_loss, predictions_after_filter, update_flags, prediction_format, sequential_linear, delayed_linear, many_models_linear, warm_start_linear, minibatch_linear, sql_predict, weight_stats, dequantize, weight_diff, weight_diff_apply, inference_convert, model_averaging, sequential_train, delayed_train, warm_start, many_models_train, hogwild_train, minibatch_train, model_save_load, quantize_roundtrip, record_cache, stream_score, hot_swap, event_windows)
    return {f.__name__: f for f in plain} | named
