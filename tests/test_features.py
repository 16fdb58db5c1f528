"""Column expressions against the plain-Python form of the same definitions."""

import math

import pytest
from pyspark.sql import functions as F

from sparsemill.operators.features import featurize
from sparsemill.plans.dsl import DslError, resolve
from sparsemill.plans.spec import ModelSpec, SpecError, from_args
from sparsemill.sources import local, vector
from sparsemill.sources.catalog import Catalog
from sparsemill.sources.text import parse

CATALOG = Catalog.from_rows([("A", "featureA"), ("B", "featureB", "f32"), ("C", "featureC", "f32"), ("D", "featureD"), ("EE", "featureE")])
LINES = [
    "1 |A a",
    "-1 |A a b |B 3",
    "1 2.5 |A:2 a:3 b |D x",
    "|A a |B 7.5 |C 2",
    "0.5 |A a",
    "1 |A a |Z z",
    "1 |A a:x",
    "1 |A:x a",
    "1 -2 |A a",
    "1 foo |A a",
    "1 |B not_a_number",
    "1 |B 3:3",
    "1 |B:3 3",
    "1 |B NONE |C 50",
    "1 |B 300 400 |C 0",
    "1 |B 0 |C 100",
    "10  |A  a   b  ",
    "-0 |A x |A y",
    "1",
    "1 |A",
    "1 | a",
    "1 |A a|b c",
    "1 |B 5.4 |C 1e20",
    "1 |B 3 4 |C 1 2 |A q |D r s",
    "1 |EE multi byte |D é:0.5",
    "flush",
    "hogwild_load /some/file",
    "unknown words in here",
    "1 |B -5 |C -7",
    "1 |B 40 |C 40 |A z",
]
SPEC = (
    "--keep A --keep D:1.5 --interactions AD --interactions ADB:2 --linear featureA,t_comb --linear t_sqrt --linear t_sqrtp --linear t_log --linear t_ratio --linear t_ratiop --linear t_weight --linear t_nested "
    "--transform t_sqrt=BinnerSqrt(featureB)(40,1) --transform t_sqrtp=BinnerSqrtPlain(featureB)() --transform t_log=BinnerLog(featureB)(1,10) --transform t_ratio=BinnerLogRatio(featureB,featureC)(40,10) "
    "--transform t_ratiop=BinnerLogRatioPlain(featureB,featureC)() --transform t_weight=Weight(featureA)(40) --transform t_comb=Combine(featureA,featureD)() --transform t_nested=Combine(t_comb,featureB)() "
    "--ffm_k 3 --ffm_field AD --ffm_field B --ffm_field_verbose t_weight,featureE"
)


def test_lines_and_features(spark):
    spec = from_args(SPEC, CATALOG)
    spec = ModelSpec.from_json(spec.to_json())
    df = spark.createDataFrame(list(enumerate(LINES)), "example_num long, line string")
    parsed = parse(df, CATALOG)
    # used_columns of the wide table keeps only what the model reads
    rows = {r.example_num: r for r in parsed.collect()}
    feats = {r.example_num: r for r in featurize(parsed, spec).collect()}
    for i, line in enumerate(LINES):
        try:
            label, importance, found = local.parse_line(line, CATALOG)
        except local.Command as c:
            assert (rows[i].command, rows[i].argument, rows[i].error) == (c.name, c.argument, None), line
            continue
        except local.ParseError as e:
            assert rows[i].error == str(e), line
            continue
        assert rows[i].error is None and rows[i].command is None, line
        assert (rows[i].label, rows[i].importance) == (label, importance), line
        e = local.featurize(spec, found, i, label, importance)
        got = [(x.hash, x.combo) for x in feats[i].lr]
        assert got == list(zip(e.hashes.tolist(), e.combos.tolist(), strict=True)), line
        assert [x.value for x in feats[i].lr] == pytest.approx(e.values.tolist(), rel=1e-5, abs=1e-6, nan_ok=True), line
        assert [(x.hash, x.field) for x in feats[i].ffm] == list(zip(e.ffm_hashes.tolist(), e.ffm_fields.tolist(), strict=True)), line


def test_batches_are_read_as_columns_are(spark):
    more = [f"1 {k / 4} |A a{k} b:{k} |B {k}.5 |D x y|z |C -1e{k} +3" for k in range(20)] + ["", " ", "1 |A a:1e999 |B inf", "-1 1e-3 |D d:-2.5e1", "| |A x", "1|A a", "1 |A a:b:c", "1 |B 1_0", "1 |A a:1f", "1 |B 2d"]
    df = spark.createDataFrame(list(enumerate([*LINES, *more])), "example_num long, line string").repartition(3)
    show = lambda rows: sorted(str(r) for r in rows)
    for a, b in zip(show(parse(df, CATALOG).collect()), show(vector.parse(df, CATALOG).collect()), strict=True):
        assert a == b
    spec = from_args("--keep A --interactions ADB:2 --keep D:1.5 --linear featureE,featureA --ffm_k 3 --ffm_field AD --ffm_field B", CATALOG)
    want = featurize(parse(df, CATALOG), spec)
    got = vector.featurize(df, spec).select(*want.columns)
    assert show(got.collect()) == show(want.collect())


def test_interpolated_emissions():
    seed = 5
    both = local._emit_float(seed, 5.4, True)
    assert [x[0] for x in both] == [local._emit(seed, 1, 6)[0], local._emit(seed, 1, 5)[0]]
    assert [x[1] for x in both] == pytest.approx([0.4, 0.6], abs=1e-6)
    assert len(local._emit_float(seed, 5.0, True)) == 1 and len(local._emit_float(seed, math.inf, True)) == 1


@pytest.mark.parametrize(
    ("statements", "message"),
    [
        (["a=Weight(b)(1)", "b=Weight(a)(1)"], "Cyclic dependency detected"),
        (["a=Weight(a)(1)"], "Cyclic dependency detected"),
        (["a=Weight(nowhere)(1)"], 'Could not find namespace "nowhere"'),
        (["a=Foo(featureA)()"], "Unknown transformer function: Foo"),
        (["a=Combine(featureA,featureA)()"], "Using the same from namespace"),
        (["featureA=Weight(featureB)(1)"], "already exists as primitive namespace"),
        (["a=Weight(featureB)(1)", "a=Weight(featureC)(1)"], "already exists"),
        (["a=BinnerSqrt(featureA)()"], "have to be of type f32"),
        (["a=BinnerSqrt(featureB)(-1)"], "cannot be negative"),
        (["a=BinnerSqrt(featureB)(1,2,3)"], "up to two"),
        (["a=Combine(featureA)()"], "between 2 and 4"),
        (["a=Weight(featureA)()"], "exactly one float"),
        (["a Weight"], "Error parsing"),
    ],
)
def test_statement_errors(statements, message):
    with pytest.raises(DslError, match=message.replace("(", r"\(")):
        resolve(statements, CATALOG)


def test_order_and_trailing_text():
    found = resolve(["z=Weight(b)(1) and more", " b = Weight ( featureA ) ( 2 ) "], CATALOG)
    assert [(t.name, t.index) for t in found] == [("b", 0), ("z", 1)]


@pytest.mark.parametrize(
    ("args", "message"),
    [
        ("--keep A:1:2", "only one value"),
        ("--keep A:x", "Could not parse the value"),
        ("--keep Q", "Unknown namespace char"),
        ("--linear nowhere", "Unknown verbose namespace"),
        ("--ffm_field A:2", "Fields currently do not support"),
        ("--ffm_k 200", "Maximum ffm_k is: 128, passed: 200"),
        ("--link identity", "--link only supports"),
        ("--loss_function squared", "--loss_function only supports"),
        ("--l2 0.1", "--l2 can only be 0.0"),
        ("--vwcompat", "--keep"),
        ("--vwcompat --keep A", "--hash all"),
        ("--vwcompat --keep A --hash all", "--sgd"),
        ("--nn_layers 1 --nn 0:width", "of form"),
        ("--nn_layers 1 --nn 1:width:3", "only 1 layers"),
        ("--nn_layers 1 --nn 0:what:3", "Unknown --nn parameter"),
        ("--nn_layers 1 --nn_topology three", "unknown nn topology"),
    ],
)
def test_option_errors(args, message):
    with pytest.raises(SpecError, match=message):
        from_args(args, CATALOG)


def test_rates_cascade():
    s = from_args("--keep A -l 0.3 --power_t 0.2 --ffm_learning_rate 0.1 --adaptive", CATALOG)
    assert (s.lr.learning_rate, s.ffm.learning_rate, s.nn.learning_rate, s.nn.power_t, s.optimizer) == (0.3, 0.1, 0.1, 0.2, "adagrad_lut")
    s = from_args("--keep A --vwcompat --hash all --sgd --adaptive", CATALOG)
    assert (s.optimizer, s.lr.init_acc) == ("adagrad_flex", 0.0)


def test_catalog():
    with pytest.raises(ValueError, match='Only "f32" is possible'):
        Catalog.from_rows([("A", "a", "blah")])
    c = Catalog.from_rows([("A", "a"), ("_namespace_skip_prefix", "2"), ("B", "b", "f32")])
    assert (c.skip_prefix, c.by_name("B").index, c.num_namespaces) == (2, 2, 3)
    assert Catalog.from_json(c.to_json()) == c
    assert local.parse_line("1 |B XX3", c)[2]["ns_B"][0][2] == 3.0


def test_shared_prefix(spark):
    df = spark.createDataFrame([(1, "|D x")], "example_num long, line string")
    whole = spark.createDataFrame([(1, "1 |A a |D x")], "example_num long, line string")
    assert parse(df, CATALOG, prefix="1 |A a ").collect() == parse(whole, CATALOG).collect()


def test_only_used_namespaces_are_hashed(spark):
    spec = from_args("--keep A", CATALOG)
    plan = featurize(parse(spark.createDataFrame([(1, "1 |A a")], "example_num long, line string"), CATALOG), spec)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("run(") <= 2 and F is not None
