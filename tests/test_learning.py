"""Learning, scoring, storing and serving over DataFrames."""

import os
import socket
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsemill import cli
from sparsemill.operators import learn, metrics, score, weights
from sparsemill.operators.features import featurize
from sparsemill.operators.learner import Learner, example
from sparsemill.operators.optimizers import TABLE_BITS
from sparsemill.plans.spec import SpecError, from_args
from sparsemill.sources import cache, local, model_store, sql, text, vector
from sparsemill.sources.catalog import Catalog
from sparsemill.sources.generate import as_lines, eats
from sparsemill.storage import release, shared_dir, stored
from sparsemill.streaming.daemon import Daemon
from sparsemill.streaming.serve import Server, learn_stream, serve

CATALOG = Catalog.from_rows([("A", "animal"), ("B", "food")])
LINEAR = "--keep A --keep B --interactions AB --adaptive -l 0.1 --power_t 0.3 -b 14"
FFM = f"{LINEAR} --ffm_k 4 --ffm_field A --ffm_field B --ffm_bit_precision 14 --ffm_init_width 0.3"


def eaten(spark, n, args, hard=False, seed=1):
    spec = from_args(args, CATALOG)
    rows = eats(spark, n, hard, ids=60, foods=60, beyond=10, noise=0, seed=seed)
    return spec, featurize(text.from_table(rows, "example_num", F.col("label"), {"A": F.col("animal"), "B": F.col("food")}, CATALOG), spec)


def by_hand(spec, features, **options):
    learner, out = Learner(spec), {}
    for r in features.orderBy("example_num").collect():
        e = example(r.example_num, r.label, r.importance, [tuple(x) for x in r.lr], [tuple(x) for x in r.ffm])
        out[r.example_num] = learner.learn(e)
    return learner, out


@pytest.mark.parametrize("args", [LINEAR, FFM, LINEAR.replace("--adaptive", "--sgd"), f"{FFM} --nn_layers 1 --nn 0:width:3 --nn 0:activation:relu"])
def test_sequential_is_in_order(spark, args):
    spec, features = eaten(spark, 400, args)
    learner, want = by_hand(spec, features)
    predictions, table = learn.sequential(features.repartition(7), spec)
    got = {r.example_num: r.prediction for r in predictions.collect()}
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()), abs=2e-5)
    w = {(r.block, r.idx): r.w for r in table.collect()}
    block, idx, values, _ = learner.weights()[0]
    assert [w["lr", int(i)] for i in idx] == pytest.approx(values.tolist(), abs=2e-4)


def test_delay_holdout_after_and_warm_start(spark):
    spec, features = eaten(spark, 300, LINEAR)
    delayed = {r.example_num: r.prediction for r in learn.sequential(features, spec, delay=50)[0].collect()}
    assert all(delayed[i] == 0.5 for i in range(1, 51)) and any(delayed[i] != 0.5 for i in range(52, 300))
    assert learn.sequential(features, spec, delay=400)[1].count() == 0
    held, w = learn.sequential(features, spec, holdout_after=100, predictions_after=200)
    assert held.count() == 100
    first = learn.sequential(features.where("example_num < 100"), spec)[1]
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, first.collect()))
    _, one = by_hand(spec, features)
    half = learn.sequential(features.where("example_num <= 150"), spec)[1]
    rest = {r.example_num: r.prediction for r in learn.sequential(features.where("example_num > 150"), spec, half)[0].collect()}
    assert [rest[i] for i in range(151, 301)] == pytest.approx([one[i] for i in range(151, 301)], abs=1e-4)


def hashed(n, values, seed=3):
    """Examples of six features each, as the fold reads them; each shares some, and some repeat one."""
    rng = np.random.default_rng(seed)
    rows = [[{"hash": int(h), "value": float(v), "combo": 0} for h, v in zip(rng.integers(0, 40, 6), rng.choice([0.5, 1.0, 2.0], 6) if values else np.ones(6), strict=True)] for _ in range(n)]
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("value", pa.float32()), ("combo", pa.int32())]))
    labels = [None if k % 11 == 5 else int(rng.random() < 0.4) for k in range(n)]
    return pa.table({"example_num": range(1, n + 1), "label": labels, "importance": pa.array([2.0 if k % 7 == 0 else None if k % 5 else 1.0 for k in range(n)], pa.float32()), "lr": pa.array(rows, kind), "ffm": pa.nulls(n, kind)})


@pytest.mark.parametrize("values", [False, True])
@pytest.mark.parametrize("options", ["--sgd --adaptive --power_t 0.0", "--sgd --adaptive --power_t 0.5", "--adaptive --power_t 0.3", "--sgd"])
def test_linear_folds_are_the_same_in_batches_and_models_of_any_size(options, values):
    """Against a plain loop in double precision, with and without delay."""
    table = hashed(400, values)
    for bits in (6, 22):
        spec = from_args(f"--keep A -l 0.1 -b {bits} {options}", CATALOG)
        for delay in (0, 30):
            found = []
            for size in (400, 64, 1):
                out = list(learn.LinearFold(spec).fold(iter(table.to_batches(max_chunksize=size)), delay=delay))
                found.append(([x for b in out for x in b.column(2).to_pylist() if x is not None], [(i, w, a) for b in out for i, w, a in zip(*(b.column(c).to_pylist() for c in (4, 5, 6)), strict=True) if i is not None]))
            assert found[0] == found[1] == found[2] and len(found[0][0]) == 400
            opt, w, acc = learn.LinearFold(spec).opt, np.zeros(40), np.full(40, float(learn.LinearFold(spec).opt.start))
            rows = table.to_pylist()

            def total(r, w=w):
                return sum(w[x["hash"]] * x["value"] for x in r["lr"])

            for k, r in enumerate(rows):
                assert found[0][0][k] == pytest.approx(1 / (1 + np.exp(-total(r))), abs=1e-9)
                r = r if not delay else rows[k - delay] if k >= delay else None
                if r is None or r["label"] is None:
                    continue
                g = (1 / (1 + np.exp(-total(r))) - r["label"]) * (1.0 if r["importance"] is None else r["importance"])
                for x in r["lr"]:
                    h, gv = x["hash"], g * x["value"]
                    acc[h] += 0 if opt.kind == "sgd" else gv * gv
                    rate = opt.rate if opt.kind == "sgd" else opt.table[np.float32(acc[h]).view(np.uint32) >> np.uint32(31 - TABLE_BITS)] if opt.kind == "adagrad_lut" else opt.rate * acc[h] ** float(opt.power)
                    w[h] -= gv * float(rate)
            assert [x[0] for x in found[0][1]] == np.flatnonzero((w != 0) | (acc != float(opt.start))).tolist()
            assert [x[1] for x in found[0][1]] == pytest.approx([w[x[0]] for x in found[0][1]], abs=1e-6)
            assert [x[2] for x in found[0][1]] == pytest.approx([acc[x[0]] for x in found[0][1]], rel=1e-6)


def test_many_models_are_each_their_own(spark):
    spec, features = eaten(spark, 200, LINEAR)
    out = learn.many_models(features.withColumn("model_id", F.col("example_num") % 3), spec)
    for m in range(3):
        want = {r.example_num: r.prediction for r in learn.sequential(features.where(F.col("example_num") % 3 == m), spec)[0].collect()}
        got = {r.example_num: r.prediction for r in out.where(f"model_id = '{m}' and kind = 'prediction'").collect()}
        assert got == want


def test_relational_score_is_the_learners(spark):
    spec, features = eaten(spark, 300, FFM)
    learner, _ = by_hand(spec, features)
    rows = [(b, int(i), float(w), float(a)) for b, idx, ws, accs in learner.weights() for i, w, a in zip(idx, ws, accs, strict=True)]
    table = spark.createDataFrame(rows, learn.WEIGHTS)
    got = {r.example_num: r.prediction for r in score.score(features, spec, table.where("block = 'lr'"), table.where("block = 'ffm'")).collect()}
    own = {r.example_num: r.prediction for r in learn.score_local(features, spec, table).collect()}
    for r in features.collect():
        want = learner.predict(example(0, None, 1.0, [tuple(x) for x in r.lr], [tuple(x) for x in r.ffm]))
        assert got[r.example_num] == pytest.approx(want, abs=1e-5) and own[r.example_num] == pytest.approx(want, abs=1e-5)


def test_sparse_weights_are_the_dense_ones(monkeypatch):
    rng = np.random.default_rng(1)
    idx = rng.choice(1 << 12, 500, replace=False)
    w = rng.normal(size=500).astype(np.float32)
    hashes = rng.integers(0, 1 << 12, 3000)
    dense = learn.LinearWeights(12, idx, w)[hashes]
    monkeypatch.setattr(learn.LinearWeights, "DENSE", 1)
    assert (learn.LinearWeights(12, idx, w)[hashes] == dense).all() and (learn.LinearWeights(12, idx[:0], w[:0])[hashes] == 0).all()


def test_fields_generalise_to_unseen_pairs(spark):
    """Hard pairs never occur in training: linear models can't tell them, fields can."""
    args = "--keep A --keep B --ffm_k 8 --ffm_field A --ffm_field B --ffm_init_width 0.5 --adaptive -l 0.2 --power_t 0.3 -b 16 --ffm_bit_precision 16"
    spec, train = eaten(spark, 8000, args)
    _, hard = eaten(spark, 1000, args, hard=True, seed=9)
    accuracy = {}
    for name, a in (("fields", args), ("linear", "--keep A --keep B --adaptive -l 0.2 --power_t 0.3 -b 16")):
        s = from_args(a, CATALOG)
        _, w = learn.sequential(train, s)
        scored = learn.score_local(hard, s, w).join(hard.select("example_num", "label"), "example_num")
        accuracy[name] = metrics.confusion(scored).first().balanced_accuracy
    assert accuracy["fields"] > 0.8 and abs(accuracy["linear"] - 0.5) < 0.1


def fielded(n, values, seed=5):
    """Examples of linear features and of none to four features in three fields, as the folds read them, as structs and as plain lists; some repeat one."""
    table, rng = hashed(n, values, seed), np.random.default_rng(seed)
    rows = [[{"hash": int(rng.integers(0, 30)) * 6, "value": float(rng.choice([0.5, 1.0, 2.0])) if values else 1.0, "field": int(f)} for f in rng.integers(0, 3, rng.integers(0, 5))] for _ in range(n)]
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("value", pa.float32()), ("field", pa.int32())]))
    table = table.drop_columns(["ffm"]).append_column("ffm", pa.array(rows, kind))
    lists = table.drop_columns(["lr", "ffm"])
    for name, column, key, t in (("hash", "lr", "hash", pa.int64()), ("value", "lr", "value", pa.float32()), ("field_hash", "ffm", "hash", pa.int64()), ("field_value", "ffm", "value", pa.float32()), ("field_field", "ffm", "field", pa.int32())):
        lists = lists.append_column(name, pa.array([[x[key] for x in r] for r in table.column(column).to_pylist()], pa.list_(t)))
    return table, lists


def folded(out):
    out = [x for b in out for x in b.to_pylist()]
    return [x["prediction"] for x in out if x["kind"] == "prediction"], {(x["block"], x["idx"]): (x["w"], x["acc"]) for x in out if x["kind"] == "weight"}


@pytest.mark.parametrize("values", [False, True])
@pytest.mark.parametrize("options", ["--sgd --adaptive --power_t 0.0", "--sgd --adaptive --power_t 0.5", "--adaptive --power_t 0.3", "--sgd"])
def test_field_folds_equal_a_learner(options, values):
    spec = from_args(f"--keep A -l 0.05 -b 6 --ffm_k 2 --ffm_field A --ffm_field B --ffm_field AB --ffm_bit_precision 8 --ffm_init_width 0.3 {options}", CATALOG)
    table, lists = fielded(300, values)
    for some in ({}, {"delay": 30}, {"holdout_after": 200, "predictions_after": 100}, {"testonly": True}):
        p, w = folded(learn.fold(Learner(spec), iter(table.to_batches()), **some))
        for size, rows in ((300, table), (64, lists), (1, lists)):
            made = learn.folder(spec)
            q, u = folded(made.fold(iter(rows.to_batches(max_chunksize=size)), **some))
            assert isinstance(made, learn.FieldFold) and q == pytest.approx(p, abs=2e-5) and u.keys() == w.keys()
            assert all(u[k] == pytest.approx(w[k], abs=2e-4, rel=2e-4) for k in w)


def test_field_folds_are_fast():
    spec = from_args(f"{FFM.replace('--ffm_k 4', '--ffm_k 2')}", CATALOG)
    rows, seconds = pa.Table.from_batches(fielded(2000, False)[0].to_batches()), []
    for run in (lambda: learn.fold(Learner(spec), iter(two), delay=100), lambda: learn.folder(spec).fold(iter(two), delay=100)):
        # Fields 0 and 1 only, as the model has two.
        two = [b for b in rows.filter(pa.array([all(x["field"] < 2 for x in r) for r in rows.column("ffm").to_pylist()])).to_batches()]
        began = time.process_time()
        list(run())
        seconds.append(time.process_time() - began)
    assert seconds[1] < seconds[0] / 3


def test_averaging_and_minibatches_learn(spark):
    spec, features = eaten(spark, 3000, LINEAR.replace("0.3", "0.5"))
    w = learn.averaged(features, spec, 3)
    for table in (w, learn.minibatch(features, spec, batches=3, epochs=3)[0].select(F.lit("lr").alias("block"), "idx", "w")):
        scored = learn.score_local(features, spec, table).join(features.select("example_num", "label"), "example_num")
        assert metrics.mean_logloss(scored).first().logloss < 0.68


def test_one_example_is_one_minibatch(spark):
    for kind in ("--sgd", "--adaptive"):
        spec, features = eaten(spark, 1, f"--keep A --interactions AB --ffm_k 2 --ffm_field A --ffm_field B --ffm_bit_precision 8 {kind} -l 0.1 --power_t 0.5")
        learner, _ = by_hand(spec, features)
        lr, ffm = learn.minibatch(features, spec)
        got = {r.idx: r.w for r in lr.collect()}
        assert got == pytest.approx({int(i): float(w) for i, w in zip(*learner.weights()[0][1:3], strict=True)}, abs=1e-6)
        fields = np.array([r.w for r in ffm.orderBy("idx").collect()])
        assert np.allclose(fields, learner.fw, atol=1e-6)


def test_minibatches_come_back_from_beyond_the_clamp(spark):
    """Against plain sums: the first of these steps carries every example's sum beyond 50."""
    spec, features = eaten(spark, 400, "--noconstant --keep A --keep B --sgd -l 100 -b 14")
    rows = [({x.hash for x in r.lr}, r.label) for r in features.collect()]
    want = dict.fromkeys(set().union(*(x for x, _ in rows)), 0.0)
    beyond = []
    for _ in range(3):
        totals = [sum(want[h] for h in x) for x, _ in rows]
        beyond.append(sum(abs(t) > 50 for t in totals))
        p = 1 / (1 + np.exp(-np.clip(totals, -50, 50)))
        for (x, label), q in zip(rows, p, strict=True):
            for h in x:
                want[h] -= 100 * (q - label)
    assert beyond[1] > 300
    got = {r.idx: r.w for r in learn.minibatch(features, spec, epochs=3)[0].collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_store_checks_and_converts(spark, tmp_path):
    spec, features = eaten(spark, 100, FFM)
    _, w = learn.sequential(features, spec)
    model_store.save(spec, w, f"{tmp_path}/m")
    again, rows = model_store.load(spark, f"{tmp_path}/m", like=spec)
    assert again.to_json() == spec.to_json() and sorted(map(tuple, rows.collect())) == sorted(map(tuple, w.collect()))
    changed, _ = model_store.load(spark, f"{tmp_path}/m", learning_rate=0.7, ffm_power_t=0.1)
    assert (changed.lr.learning_rate, changed.lr.power_t, changed.ffm.learning_rate, changed.ffm.power_t) == (0.7, spec.lr.power_t, spec.ffm.learning_rate, 0.1)
    model_store.convert_to_inference(spark, f"{tmp_path}/m", f"{tmp_path}/i")
    s, rows = model_store.load(spark, f"{tmp_path}/i")
    assert s.optimizer == "sgd" and rows.columns == ["block", "idx", "w"]
    model_store.convert_to_inference(spark, f"{tmp_path}/m", f"{tmp_path}/q", quantized=True)
    s, rows = model_store.load(spark, f"{tmp_path}/q")
    a = {r.example_num: r.prediction for r in learn.score_local(features, s, rows).collect()}
    b = {r.example_num: r.prediction for r in learn.score_local(features, spec, w).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 0.01
    with pytest.raises(ValueError, match="differs"):
        model_store.load(spark, f"{tmp_path}/m", like=from_args(LINEAR, CATALOG))
    part = next(f for f in os.listdir(f"{tmp_path}/m/weights/block=ffm") if f.endswith(".parquet"))
    os.remove(f"{tmp_path}/m/weights/block=ffm/{part}")
    with pytest.raises(ValueError, match="Lengths of weights"):
        model_store.load(spark, f"{tmp_path}/m")


def test_cache(spark, tmp_path):
    path = f"{tmp_path}/train.vw"
    with open(path, "w") as f:
        f.write("1 |A a |B b\n-1 |A c |B d\n")
    first = cache.examples(spark, path, CATALOG, use_cache=True).collect()
    with open(path, "a") as f:
        f.write("1 |A z |B z\n")
    assert cache.examples(spark, path, CATALOG, use_cache=True).collect() == first
    other = Catalog.from_rows([("A", "animal"), ("B", "food"), ("C", "more")])
    assert not cache.valid(spark, other, cache.cache_path(path)) and cache.examples(spark, path, other, use_cache=True).count() == 3


@pytest.mark.parametrize("ending", ["vw", "gz", "zst"])
def test_files(spark, tmp_path, ending):
    import gzip

    import zstandard

    data = "".join(f"1 |A a{i}\n" for i in range(500)).encode()
    packed = {"vw": data, "gz": gzip.compress(data[:2000]) + gzip.compress(data[2000:]), "zst": zstandard.compress(data)}[ending]
    path = f"{tmp_path}/x.{ending}"
    open(path, "wb").write(packed)
    rows = text.read_lines(spark, path).orderBy("example_num").collect()
    assert [(r.example_num, r.line) for r in rows] == [(i + 1, f"1 |A a{i}") for i in range(500)]
    with pytest.raises(ValueError, match="valid input format"):
        text.read_lines(spark, f"{tmp_path}/x.csv")


def test_command_line(spark, tmp_path):
    rows = as_lines(eats(spark, 300, ids=20, beyond=5, noise=0)).orderBy("example_num").collect()
    with open(f"{tmp_path}/train.vw", "w") as f:
        f.write("".join(f"{r.line}\n" for r in rows))
    with open(f"{tmp_path}/vw_namespace_map.csv", "w") as f:
        f.write("A,animal\nB,food\n")
    base = ["--data", f"{tmp_path}/train.vw", *LINEAR.split()]
    cli.run(spark, [*base, "-p", f"{tmp_path}/p", "-f", f"{tmp_path}/model", "--save_resume", "-c"])
    spec, features = eaten(spark, 1, LINEAR)
    lines = open(f"{tmp_path}/p").read().split()
    assert len(lines) == 300 and lines[0] == "0.500000" and os.path.isdir(f"{tmp_path}/train.vw.examples")
    scored = cli.run(spark, ["--data", f"{tmp_path}/train.vw", "-t", "-i", f"{tmp_path}/model", "--predictions_after", "100"])
    assert scored.count() == 200
    cli.run(spark, ["-i", f"{tmp_path}/model", "--convert_inference_regressor", f"{tmp_path}/small"])
    again = cli.run(spark, ["--data", f"{tmp_path}/train.vw", "-t", "-i", f"{tmp_path}/small", "--predictions_after", "100"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))
    assert cli.run(spark, [*base, "--hogwild_training", "--hogwild_threads", "2"]).count() == 300
    assert cli.run(spark, [*base, "--build_cache_without_training"]) is None
    for wrong, message in ((["-f", "x"], "--save_resume"), (["-t", "--holdout_after", "3"], "holdout_after"), (["--convert_inference_regressor", "x", "--adaptive"], "adaptive")):
        with pytest.raises(SpecError, match=message):
            cli.run(spark, [*(base if "--convert_inference_regressor" not in wrong else []), *wrong])


def test_predictor(spark):
    spec = from_args(FFM, CATALOG)
    p = local.Predictor(spec)
    p.learner.w[:] = np.linspace(-1, 1, len(p.learner.w))
    whole = p.predict("|A cat |B fish")
    other = p.clone()
    assert other.setup_context("|A cat ") == 0.0 and other.predict_with_context("|B fish") == whole == p.predict("|A cat |B fish\n")
    assert p.predict("bad") == p.predict("|Q x") == p.predict("flush") == -1.0 and other.setup_context("|Q x") == -1.0
    assert other.predict_with_context("|A cat |B fish") == whole


def test_context_scores_are_those_of_whole_lines(spark):
    spec = from_args("--keep A --keep B --ffm_k 2 --ffm_field AB --ffm_field B --ffm_bit_precision 10 -b 10", CATALOG)
    lines = lambda rows: featurize(text.parse(spark.createDataFrame(rows, "example_num long, line string"), CATALOG), spec)
    contexts, own = {1: "|A cat", 2: "|A dog cow"}, {10: (1, "|B fish"), 11: (1, "|B hay:2"), 12: (2, "|B fish meat")}
    whole = lines([(k, f"{contexts[c]} {t}") for k, (c, t) in own.items()])
    lr = spark.range(1 << 10).select(F.col("id").alias("idx"), (F.col("id") % 7 - 3.0).alias("w"))
    ffm = spark.range((1 << 10) + 4).select(F.col("id").alias("idx"), ((F.col("id") % 11 - 5) / 10).alias("w"))
    want = {r.example_num: r.prediction for r in score.score(whole, spec, lr, ffm).collect()}
    spec.constant = False
    cand = lines([(k, t) for k, (_, t) in own.items()]).join(spark.createDataFrame([(k, c) for k, (c, _) in own.items()], "example_num long, ctx long"), "example_num")
    spec.constant = True
    ctx = lines(list(contexts.items())).withColumnRenamed("example_num", "ctx").select("ctx", "lr", "ffm")
    got = {r.example_num: r.prediction for r in score.score_with_context(ctx, cand.select("ctx", "example_num", "lr", "ffm"), spec, lr, ffm).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_serving(spark, tmp_path):
    spec = from_args("--keep A -b 8 --noconstant", CATALOG)
    for name, w in (("one", 0.0), ("two", 1.0)):
        model_store.save(spec, spark.range(256).select(F.lit("lr").alias("block"), F.col("id").alias("idx"), F.lit(w).cast("float").alias("w"), F.lit(0.0).cast("float").alias("acc")), f"{tmp_path}/{name}")
    model_store.save(from_args("--keep B -b 8", CATALOG), spark.createDataFrame([("lr", 1, 1.0, 0.0)], learn.WEIGHTS), f"{tmp_path}/other")
    server, n = Server(spark, f"{tmp_path}/one"), iter(range(100))
    answer = lambda *lines: [r.response for r in server.answer(spark.createDataFrame([(next(n), x) for x in lines], "example_num long, line string")).orderBy("example_num").collect()]
    assert answer("|A x", "|Q x", "flush") == ["0.500000", "ERR: Feature name was not predeclared in vw_namespace_map.csv: Q"]
    assert answer(f"hogwild_load {tmp_path}/other", f"hogwild_load {tmp_path}/none") == ["ERR: hogwild_load fail"] * 2
    assert answer(f"hogwild_load {tmp_path}/two") == ["hogwild_load success"]
    assert answer("|A x") == ["0.731059"]
    pointer = f"{tmp_path}/pointer.txt"
    open(pointer, "w").write(f"{tmp_path}/one\n")
    server.pointer = pointer
    assert answer("|A x") == ["0.500000"]
    spark.createDataFrame([(1, "|A x"), (2, "nonsense")], "example_num long, line string").write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("example_num long, line string").parquet(f"{tmp_path}/in")
    serve(stream, server, lambda batch, _: seen.extend(batch.collect()), f"{tmp_path}/checkpoint", once=True).awaitTermination()
    assert sorted(map(tuple, seen)) == [(1, "0.500000"), (2, "ERR: Cannot parse an example")]


def test_learning_from_a_stream(spark):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spec, features = eaten(spark, 200, LINEAR)
    _, want = by_hand(spec, features)
    for part in range(2):
        features.where(F.floor((F.col("example_num") - 1) / 100) == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(features.schema).parquet(f"{root}/in")
        learn_stream(stream, spec, f"{root}/models", f"{root}/checkpoint", once=True).awaitTermination()
    got = {r.example_num: r.prediction for r in spark.read.schema("example_num long, prediction double").parquet(f"{root}/models/predictions").collect()}
    assert [got[i] for i in want] == pytest.approx(list(want.values()), abs=1e-4)


def test_weight_bytes():
    rng = np.random.default_rng(1)
    old = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    new = bytearray(old)
    for at in (0, 1, 130, 4999, 300):
        new[at] ^= 5
    assert weights.apply_diff_bytes(old, weights.diff_bytes(old, bytes(new))) == bytes(new)
    assert weights.apply_diff_bytes(old, weights.diff_bytes(old, old)) == old
    with pytest.raises(ValueError, match="length"):
        weights.diff_bytes(old, old + b"x")
    for n in (0, 1, 127, 128, 300, 2**40):
        assert weights.read_varint(weights.varint(n)) == (n, len(weights.varint(n)))
    w = np.array([0.51, 0.12, 0.11, 0.1232, 0.6123, 0.23], np.float32)
    packed = weights.quantized_bytes(w)
    assert len(packed) == 8 + 12 and np.abs(weights.dequantized_bytes(packed) - w).sum() < 1e-3
    same = np.full(4, 0.25, np.float32)
    assert np.allclose(weights.dequantized_bytes(weights.quantized_bytes(same)), same)


def test_weight_tables(spark):
    a = spark.createDataFrame([(i, i % 256) for i in range(3000)], "pos long, b int")
    b = a.withColumn("b", F.when(F.col("pos").isin(0, 7, 2999), (F.col("b") + 1) % 256).otherwise(F.col("b")))
    changes = weights.diff(a, b)
    assert [tuple(r) for r in changes.select("pos", "delta").orderBy("pos").collect()] == [(0, 0), (7, 7), (2999, 2992)]
    assert sorted(weights.apply_diff(a, changes).collect()) == sorted(b.collect())
    with pytest.raises(Exception, match="differ in length"):
        weights.diff(a, b.where("pos < 10")).collect()
    q = weights.quantize(spark.createDataFrame([(0, 0.5), (1, 0.5)], "idx long, w double"))
    assert [r.w for r in weights.dequantize(q).collect()] == [0.5, 0.5]


def test_dense_layers(spark):
    x = spark.createDataFrame([([1.0, -2.0, 3.0],)], "x array<double>")
    get = lambda c: x.select(c.alias("y")).first().y
    assert get(score.relu(F.col("x"))) == [1.0, 0.0, 3.0]
    halves = [[F.lit(2.0), F.lit(4.0)], [F.lit(4.0), F.lit(5.0)]]
    assert get(F.array(*score.triangle(halves))) == [2.0, 8.0, 5.0]
    v, mean = np.array([1.0, -2.0, 3.0]), 2 / 3
    spread = np.sqrt((((mean**2 - v) ** 2).sum() + 1e-2) / 3)
    assert get(score.normalize(F.col("x"))) == pytest.approx(v / spread)
    assert get(score.normalize(F.col("x"), True)) == pytest.approx((v - mean) / spread)
    assert get(score.dense(F.col("x"), [[1, 2, 3], [0, 1, 0]], [0.5, 0.0])) == [6.5, -2.0]


def test_empty_inputs(spark):
    spec, features = eaten(spark, 3, FFM)
    none = features.where("false")
    assert learn.sequential(none, spec)[0].count() == 0 and score.score(none, spec, spark.createDataFrame([], "idx long, w double")).count() == 0
    unlabelled = features.withColumn("label", F.lit(None).cast("int"))
    assert learn.sequential(unlabelled, from_args(LINEAR, CATALOG))[1].count() == 0


def closed_model(spark, path, scale=0.001):
    spec = from_args("--keep A --keep B -b 12", CATALOG)
    w = spark.range(1 << 12).select(F.lit("lr").alias("block"), F.col("id").alias("idx"), ((F.col("id") * 7919 % 1000 - 500) * scale).cast("float").alias("w"), F.lit(0.0).cast("float").alias("acc"))
    model_store.save(spec, w, path)
    return spec


def test_commands_act_on_the_lines_after_them(spark, tmp_path):
    closed_model(spark, f"{tmp_path}/one")
    closed_model(spark, f"{tmp_path}/two", 0.002)
    server = Server(spark, f"{tmp_path}/one")
    lines = ["1 |A cat", f"hogwild_load {tmp_path}/two", "1 |A cat", "1 |Z x", f"hogwild_load {tmp_path}/one", "1 |A cat", f"hogwild_load {tmp_path}/none", "1 |A cat"]
    got = [r.response for r in server.answer(spark.createDataFrame(list(enumerate(lines)), "example_num long, line string")).orderBy("example_num").collect()]
    assert got[0] == got[5] == got[7] != got[2] and got[1] == got[4] == "hogwild_load success" and got[6] == "ERR: hogwild_load fail"
    assert got[3].startswith("ERR: ") and float(got[0]) > 0


def test_daemon_answers_its_clients(spark, tmp_path):
    closed_model(spark, f"{tmp_path}/one")
    closed_model(spark, f"{tmp_path}/two", 0.002)
    daemon = Daemon(lambda path: model_store.predictor(spark, path), f"{tmp_path}/one", port=0, children=2)
    threading.Thread(target=daemon.serve_forever, daemon=True).start()

    def ask(*lines):
        with socket.create_connection(daemon.server_address, 30) as s, s.makefile("rw", encoding="utf-8", newline="\n") as f:
            out = []
            for line in lines:
                f.write(line + "\n")
                f.flush()
                out.append(None if line == "flush" else f.readline().rstrip("\n"))
            return out

    want = [f"{daemon.predictor.predict(x):.6f}" for x in ("|A cat", "|B fish")]
    assert ask("|A cat", "flush", "|B fish", "|Z x") == [want[0], None, want[1], "ERR: Feature name was not predeclared in vw_namespace_map.csv: Z"]
    with ThreadPoolExecutor(6) as pool:
        assert list(pool.map(lambda _: ask("|A cat", "|B fish"), range(12))) == [want] * 12
    assert ask(f"hogwild_load {tmp_path}/none", "|A cat") == ["ERR: hogwild_load fail", want[0]]
    assert ask(f"hogwild_load {tmp_path}/two", "|A cat")[0] == "hogwild_load success" and ask("|A cat") != [want[0]]
    daemon.shutdown()
    daemon.server_close()


def test_a_model_in_sql(spark, tmp_path):
    closed_model(spark, f"{tmp_path}/one")
    sql.register(spark, f"{tmp_path}/one", "eats")
    single = model_store.predictor(spark, f"{tmp_path}/one")
    lines = ["1 |A cat |B fish", "|A cat", "1 |Z x", "flush", None, "", "-1 |B a:2 b"]
    spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").createOrReplaceTempView("asked")
    got = [r.p for r in spark.sql("select eats(line) p from asked order by k").collect()]
    assert got == pytest.approx([-1.0 if x is None else single.predict(x) for x in lines], abs=1e-6) and got[2:6] == [-1.0] * 4


def test_large_models_are_joined(spark, monkeypatch):
    for args in (FFM, f"{FFM} --nn_layers 1 --nn 0:width:3 --nn 0:activation:relu"):
        spec, features = eaten(spark, 120, args)
        learner, _ = by_hand(spec, features)
        rows = [(b, int(i), float(w), float(a)) for b, idx, ws, accs in learner.weights() for i, w, a in zip(idx, ws, accs, strict=True)]
        table = spark.createDataFrame(rows, learn.WEIGHTS)
        want = {r.example_num: r.prediction for r in learn.score_local(features, spec, table).collect()}
        monkeypatch.setattr(learn, "LOCAL_WEIGHTS", 10)
        got = {r.example_num: r.prediction for r in learn.score_local(features, spec, table).collect()}
        monkeypatch.undo()
        assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-5)


def test_running_loss_by_ranges_is_that_in_order(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(rng.random() < 0.5), float(rng.random())) for k in rng.permutation(500).tolist()]
    scored = spark.createDataFrame(rows, "example_num long, label int, prediction double").repartition(5)
    got = [r.mean_loss for r in metrics.running_loss(scored).orderBy("example_num").collect()]
    own = [-np.log(p if y else 1 - p) for _, y, p in sorted(rows)]
    assert got == pytest.approx((np.cumsum(own) / np.arange(1, 501)).tolist())


def test_cached_examples_give_the_same_features(spark, tmp_path):
    spec = from_args("--keep A --keep B:2 --interactions AB --ffm_k 2 --ffm_field A --ffm_field B -b 18", CATALOG)
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(["1 |A a b |B c:2", "-1 0.5 |B d", "|A e", "1 |A x:0.5 y |B"])], "example_num long, line string")
    cache.write(vector.parse(lines, CATALOG), CATALOG, f"{tmp_path}/cache")
    columns = ("example_num", "label", "importance", "lr", "ffm")
    want = sorted(vector.featurize(lines, spec).select(*columns).collect())
    assert sorted(vector.featurize_examples(cache.read(spark, f"{tmp_path}/cache"), spec).select(*columns).collect()) == want


def test_stored_tables_are_released(spark):
    own = spark.newSession()
    df = stored(own.range(5).toDF("x"), "some")
    place = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(place)
    assert release(own) == 1 and not os.path.exists(place) and release(own) == 0
