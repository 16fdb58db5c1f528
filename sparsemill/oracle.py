"""The same results as SQL for DuckDB, written apart from the engine: a query's SQL by its name."""

from __future__ import annotations

import re
import struct

from .functions.hashing import CONSTANT_HASH, FNV_PRIME, MASK31, ffm_mask, lr_mask, namespace_seed, transform_seeds

M = "4294967295::UBIGINT"
C1, C2, MIX1, MIX2 = (f"{c}::UBIGINT" for c in (0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xC2B2AE35))
W = "(((({idx}) * 7919) % 1000 - 500) / {scale})"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def rotl(x: str, r: int, name: str) -> str:
    return let(x, name, f"((({name} << {r}) | ({name} >> {32 - r})) & {M})")


def block(k: str, name: str) -> str:
    return f"(({rotl(f'(({k}) * {C1} & {M})', 15, name)}) * {C2} & {M})"


def final(h: str, tag: str = "") -> str:
    a = let(h, f"f1{tag}", f"(xor(f1{tag}, f1{tag} >> 16) * {MIX1} & {M})")
    b = let(a, f"f2{tag}", f"(xor(f2{tag}, f2{tag} >> 13) * {MIX2} & {M})")
    return let(b, f"f3{tag}", f"xor(f3{tag}, f3{tag} >> 16)")


def fold_block(h: str, k: str, tag: str) -> str:
    return f"(({rotl(f'xor({h}, {block(k, f"b{tag}")})', 13, f'r{tag}')}) * 5 + 3864292196::UBIGINT) & {M}"


def string_hash(text: str, seed: int) -> str:
    """31-bit hash of a string expression."""
    digits = lambda at: f"substr(hx, ({at}) * 2 + 1, 2)"
    byte = lambda at: f"coalesce(try_cast('0x' || nullif({digits(at)}, '') as UBIGINT), 0::UBIGINT)"
    word = lambda at: "(" + " + ".join(f"{byte(f'({at}) + {j}')} * {1 << 8 * j}::UBIGINT" for j in range(4)) + ")"
    blocks = f"list_transform(range(n // 4), lambda i: {word('i * 4')})"
    head = f"list_reduce(list_prepend({seed}::UBIGINT, {blocks}), lambda a, k: {fold_block('a', 'k', 's')})"
    tail = f"(case when n % 4 > 0 then {block(word('n // 4 * 4'), 'bt')} else 0::UBIGINT end)"
    body = final(f"xor(xor({head}, {tail}), n::UBIGINT)", "s")
    whole = let(f"hex(encode({text}))", "hx", let("length(hx) // 2", "n", body))
    return f"({whole} & {MASK31}::UBIGINT)::BIGINT"


def raw_int_hash(x: str, seed: str, tag: str) -> str:
    unsigned = f"(case when ({x}) < 0 then ({x})::BIGINT + 4294967296 else ({x})::BIGINT end)::UBIGINT"
    return final(f"xor({fold_block(f'({seed})::UBIGINT', unsigned, tag)}, 4::UBIGINT)", tag)


def int_hash(seed: int, *xs: str) -> str:
    h = str(seed)
    for i, x in enumerate(xs):
        h = raw_int_hash(x, h, f"i{i}")
    return f"({h} & {MASK31}::UBIGINT)::BIGINT"


def fnv(*hs: str) -> str:
    out = hs[0]
    for g in hs[1:]:
        out = f"xor((({out}) * {FNV_PRIME}) & 4294967295, {g})"
    return out


def masked(x: str, mask: int) -> str:
    return f"(({x}) & {mask})"


def w(idx: str, scale: float = 1000.0) -> str:
    return W.format(idx=idx, scale=f"{scale}::DOUBLE")


BASE = f"""ex as (select o_orderkey ex, (o_orderstatus = 'F')::int label, replace(o_orderpriority, ' ', '_') a, replace(c_mktsegment, ' ', '_') b,
  c_nationkey::varchar c, o_totalprice::float price, c_acctbal::float bal from orders join customer on o_custkey = c_custkey)"""


def hashes(name: str, column: str, text: str | None = None, source: str = "ex") -> str:
    """A table h_<name><column> of the distinct values of a column and their hashes in a namespace."""
    return f"h{name.lower()}_{column} as (select v, {string_hash('v', namespace_seed(name))} h from (select distinct ({text or column})::varchar v from {source}))"


TOKENS = ",\n".join((BASE, hashes("A", "a"), hashes("B", "b"), hashes("C", "c"), "hx_ as (select ex.*, x.h ha, y.h hb, z.h hc from ex join ha_a x on x.v = a join hb_b y on y.v = b join hc_c z on z.v = c)"))
FLAGS = ",\n".join((f"lines_ as (select l_orderkey ex, l_returnflag g, row_number() over (partition by l_orderkey order by l_returnflag) - 1 pos from lineitem), hg as (select v, {string_hash('v', namespace_seed('G'))} h from (select distinct g v from lines_))", "fl as (select ex, pos, h hg from lines_ join hg on v = g)"))


def select(body: str, *ctes: str) -> str:
    return f"with {', '.join(ctes)} {body}" if ctes else body


def lr(*parts: tuple[int, str, str, str]) -> str:
    """ex, combo, idx, v of combinations: number, table, hash, value."""
    return " union all ".join(f"select ex, {n}::int combo, {masked(h, lr_mask(18))} idx, round(({v})::double, 4) v from {t}" for n, t, h, v in parts)


# Transforms


def _bits(x: float) -> int:
    return struct.unpack("<i", struct.pack("<f", x))[0]


def single(x: str) -> str:
    return f"({x})::float"


def trunc_int(x: str) -> str:
    return f"(case when isnan({x}) then 0 else greatest(-2147483648, least(2147483647, trunc(({x})::double)))::int end)"


def emissions(seed: int, f: str, interpolated: bool, tag: str) -> str:
    """A list of (h, v)."""
    one = lambda n, v="1.0": f"{{'h': {int_hash(seed, n)}, 'v': ({v})::float}}"
    odd = f"(case when isnan(f{tag}) then {_bits(float('nan'))} when f{tag} > 0 then {_bits(float('inf'))} else {_bits(float('-inf'))} end)"
    finite = f"isfinite(f{tag})"
    if not interpolated:
        body = f"[{one(f'(case when {finite} then {trunc_int(f"f{tag}")} else {odd} end)')}]"
    else:
        floor = f"greatest(-2147483648, least(2147483647, floor(f{tag}::double)))::bigint"
        part = f"((f{tag} - floor(f{tag})::float)::float)"
        pair = f"[{one(f'{floor} + 1', part)}, {one(floor, f'1.0::float - {part}')}]"
        body = f"case when {finite} then list_filter({pair}, lambda q{tag}: q{tag}.v <> 0) else [{one(odd)}] end"
    return let(single(f), f"f{tag}", body)


def binner(kind: str, above: float, res: float, interpolated: bool, column: str) -> str:
    s = transform_seeds(0)
    curve = "sqrt" if kind == "sqrt" else "ln"
    x = single(f"{column} - {above}::float")
    value = f"(case when {x} < 0 then 'nan'::double {'' if kind == 'sqrt' else 'when ' + x + " = 0 then '-infinity'::double "}else {curve}({x}::double) end)::float"
    low = f"[{{'h': {int_hash(s[0], trunc_int(column))}, 'v': 1.0::float}}]"
    return f"case when {column} < {above}::float then {low} else {emissions(s[1], f'({value}) * {res}::float', interpolated, 'x')} end"


def ratio(above: float, res: float, interpolated: bool) -> str:
    s = transform_seeds(0)
    ln = lambda x: f"(case when {x} > 0 then ln(({x})::double) when {x} = 0 then '-infinity'::double else 'nan'::double end)::float"
    both = f"[{{'h': {int_hash(s[1], trunc_int('price'), trunc_int('bal'))}, 'v': 1.0::float}}]"
    return (
        f"case when (price + bal)::float < {above}::float then {both} when price = 0 then {emissions(s[2], ln(f'(bal - {above}::float)'), interpolated, 'a')} "
        f"when bal = 0 then {emissions(s[3], ln(f'(price - {above}::float)'), interpolated, 'b')} else {emissions(s[0], f'({ln("(price::double / bal::double)::float")}) * {res}::float', interpolated, 'c')} end"
    )


def transformed(expr: str) -> str:
    """ex, combo, idx, v of a list of (h, v)."""
    return select(f"select ex, 0::int combo, {masked('e.h', lr_mask(18))} idx, round(e.v::double, 4) v from (select ex, unnest({expr}) e from ex)", BASE)


def combined(table: str, xor: str, seed_index: int = 0, value: str = "1.0", source: str = TOKENS) -> str:
    signed = f"(case when {xor} > 2147483647 then {xor} - 4294967296 else {xor} end)"
    return select(f"select ex, 0::int combo, {masked('h', lr_mask(18))} idx, round(({value})::double, 4) v from (select *, {int_hash(transform_seeds(seed_index)[0], signed)} h from {table})", source)


# Scoring

LR_PARTS = f"""lr as (select ex, 0 combo, {masked('ha', lr_mask(18))} idx, 1.0 v from hx_ union all select ex, 1, {masked('hb', lr_mask(18))}, 1.5 from hx_
  union all select ex, 2, {masked(fnv('ha', 'hb'), lr_mask(18))}, 1.0 from hx_ union all select ex, 3, {masked(fnv('ha', 'hb', 'hc'), lr_mask(18))}, 2.0 from hx_
  union all select ex, 4, {masked(fnv('hb', 'hc'), lr_mask(18))}, 1.0 from hx_ union all select ex, 5, {CONSTANT_HASH & lr_mask(18)}, 1.0 from hx_)"""
LR = (TOKENS, LR_PARTS)


def sigmoid(t: str) -> str:
    return f"(1 / (1 + exp(-greatest(-50, least(50, {t})))))"


def lr_totals(scale: str = "1") -> str:
    return f"tot as (select ex, sum(v * {w('idx')} * {scale}) total from lr group by ex)"


SCORED = (*LR, lr_totals(), f"sc as (select ex, total, {sigmoid('total')} p, label from tot join ex using (ex))")
LABELLED = (*SCORED, "lb as (select ex, label, round(p, 9) p from sc)")


def ffm(fields: list[tuple[str, ...]], k: int, bits: int = 18) -> str:
    """ff(ex, i, f, h, v) of fields of hash columns; hg stands for the flags."""
    mask, parts = ffm_mask(bits, k), []
    for f, columns in enumerate(fields):
        for at, c in enumerate(columns):
            parts.append(f"select ex, {f} f, {at} at_, pos, hg h from fl join ex using (ex)" if c == "hg" else f"select ex, {f}, {at}, 0 pos, {c} from hx_")
    return f"ff as (select ex, (row_number() over (partition by ex order by f, at_, pos) - 1)::int i, f, {masked('h', mask)} h, 1.0 v from ({' union all '.join(parts)}) t(ex, f, at_, pos, h))"


FFM = (TOKENS, FLAGS, ffm([("ha",), ("hb",), ("hc", "hg")], 2))
EMB = (*FFM, f"emb as (select ex, i, f, z, j, v, {w('h + z * 2 + j')} w from ff, range(3) a(z), range(2) b(j))", "cv as (select ex, f::int f, z::int z, j::int j, sum(v * w) c, sum(v * v * w * w) s from emb group by all)")
PAIRS = (*EMB, "crs as (select a.ex, a.f f1, b.f f2, sum(a.c * b.c) o from cv a join cv b on a.ex = b.ex and a.j = b.j and a.f = b.z and a.z = b.f where a.f < b.f group by all)", "dg as (select ex, f f1, sum(0.5 * (c * c - s)) o from cv where f = z group by all)")
FFM_TOTAL = "fft as (select ex, sum(o) total from (select ex, o from crs union all select ex, o from dg union all select ex, 0 from ex) group by ex)"

VECTORS = "vec as (select vec_id, embedding::double[] x, len(embedding) n from embeddings)"
ELEMENT = "select vec_id, (unnest(range(1, n + 1)) - 1)::int slot, round(unnest(y), 6) v from"
GRADS = (*SCORED, f"gr as (select idx, sum((p - label) * v) g, sum(((p - label) * v) * ((p - label) * v)) s from lr join sc using (ex) group by idx)")


def adagrad_rate(kind: str) -> str:
    if kind == "sgd":
        return "0.1"
    if kind == "adagrad_flex":
        return "0.1 * pow(a, -0.5)"
    low = "(case when a < pow(2.0, -126) then 0.0 else pow(2.0, floor(log2(a))) * (1 + floor((a / pow(2.0, floor(log2(a))) - 1) * 8) / 8) end)"
    high = "(case when a < pow(2.0, -126) then pow(2.0, -127) else low + pow(2.0, floor(log2(a))) / 8 end)"
    return let(low, "low", f"0.05 * (pow(low + 1, -0.5) + pow({high} + 1, -0.5))")


def step(kind: str) -> str:
    start = 1.0 if kind == "adagrad_flex" else 0.0
    acc = "0.0" if kind == "sgd" else f"{start} + s"
    return select(f"select idx, round({w('idx')} - g * {adagrad_rate(kind)}, 6) w, round(({acc})::double, 6) acc from (select *, {acc} a from gr)", *GRADS)


def nn_forward() -> str:
    neurons = ", ".join(f"greatest(0, {(n * 7919 % 1000 - 500) / 1000} + list_sum(list_transform(range(64), lambda i{n}: x[i{n} + 1] * ((({n * 64} + i{n}) * 7919) % 1000 - 500) / 1000)))" for n in range(8))
    return select(f"select vec_id, round({sigmoid(f'list_sum([{neurons}]) + list_sum(x)')}, 6) prediction from vec where n = 64", VECTORS)


def in_order(importance: str = "1.0", learned: str = "true", shown: str = "ex > 0", delay: int = 0, by: str = "0", decimals: int = 6) -> str:
    """Predictions of linear models over two namespaces (ten values each at most), one for each value of `by`, learned order by order: a recursion that carries all weights. With a delay, an order is learned so many orders later."""
    model = "" if by == "0" else "model model_id, "
    return f"""with recursive {BASE},
    orders_ as materialized (select {by} model, row_number() over (partition by {by} order by ex) n, ex, label, dense_rank() over (order by a) ai, 10 + dense_rank() over (order by b) bi, {importance} * ({learned})::int importance from ex),
    pairs_ as materialized (select o.*, l.ai la, l.bi lb, l.label ll, coalesce(l.importance, 0) li from orders_ o left join orders_ l on l.model = o.model and l.n = o.n - {delay}),
    state as (select distinct model, 0::bigint n, 0::bigint ex, list_transform(range(20), lambda i: 0.0::double) weights, 0.0::double p from orders_
      union all
      select model, n, ex, list_transform(weights, lambda v, i: case when i = la or i = lb then v - 0.1::float::double * ((lp - ll) * li) else v end), p
      from (select o.model, o.n, o.ex, la, lb, ll, li, weights, {sigmoid('weights[ai] + weights[bi]')} p, {sigmoid('weights[la] + weights[lb]')} lp from state join pairs_ o on o.model = state.model and o.n = state.n + 1))
    select {model}ex, round(p, {decimals}) prediction from state where n > 0 and {shown}"""


def stored_model(scale: str = "1000", second: bool = True) -> str:
    """p: the prediction of a stored model, with single weights by place, of each order."""
    h12 = lr_mask(12)
    one = lambda h: f"{w(masked(h, h12), float(scale))}::float::double"
    return sigmoid(" + ".join([one("ha"), *([one("hb")] if second else []), one(str(CONSTANT_HASH))]))


def oracle_sql() -> dict[str, str]:
    h18, line_labels = lr_mask(18), "case ex % 3 when 0 then 1 when 1 then 0 else -1 end"
    float_hash = hashes("E", "bal")
    out = {
        "label_parse": select(f"select ex, {line_labels} label from ex", BASE),
        "importance_parse": select("select ex, case ex % 4 when 0 then 1.0 when 1 then 0.5 when 2 then -2.0 end::double importance, case ex % 4 when 2 then 'Example importance cannot be negative: -2! ' when 3 then 'Failed parsing example importance: x' end error from ex", BASE),
        "feature_tokenise": select("select ex, 0::int pos, ha_a.h hash, 1.0::double v from ex join ha_a on a = v union all select ex, 1, ha_b.h, 0.5 from ex join ha_b on b = v union all select ex, 2, ha_c.h, 1.0 from ex join ha_c on c = v", BASE, hashes("A", "a"), hashes("A", "b"), hashes("A", "c")),
        "namespace_weight": select("select ex, 0::int pos, hb_b.h hash, 6.0::double v from ex join hb_b on b = v union all select ex, 1, hb_a.h, 2.0 from ex join hb_a on a = v", BASE, hashes("B", "b"), hashes("B", "a")),
        "f32_value_parse": select(f"select ex, 0::int pos, h hash, (ex % 100) + 0.25::double v from ex join hd_t on hd_t.v = (ex % 100)::varchar || '.25' union all select ex, 1, {string_hash("'NONE'", namespace_seed('D'))}, null from ex", BASE, hashes("D", "t", "(ex % 100)::varchar || '.25'")),
        "command_filter": select("select case ex % 5 when 0 then 'flush' else 'hogwild_load' end command, case ex % 5 when 1 then '/m/' || a end argument, count(*) n from ex where ex % 5 < 2 group by all", BASE),
        "ns_lookup": select("select name, ns_index, seed, count(*) n from (select ['A','B','C','D','E','G','Z'][ex % 7 + 1] name from ex) join cat using (name) group by all", BASE, "cat(name, ns_index, seed) as (values " + ", ".join(f"('{n}', {i}::int, {namespace_seed(n)}::bigint)" for i, n in enumerate("ABCDEG")) + ")"),
        "undeclared_ns_anti": select("select 'Feature name was not predeclared in vw_namespace_map.csv: Z' || c error, count(*) n from ex where ex % 3 = 0 group by all", BASE),
        "multi_value_namespace": select("select ex, pos::int pos, hg hash, 1.0::double v from fl join ex using (ex)", BASE, FLAGS),
        "token_hashes": f"select token, {string_hash('token', namespace_seed('A'))} hash from (select distinct p_name token from part)",
        "int_hashes": f"select p_partkey, {int_hash(123, 'p_partkey')} hash from part",
        "int_pair_hashes": f"select p_partkey, {int_hash(7, 'p_partkey', 'p_size')} hash from part",
        "masks": f"select o_orderkey, {masked('o_orderkey * 7919', h18)} lr_idx, {masked('o_orderkey * 7919', ffm_mask(18, 3))} ffm_idx from orders",
        "keep_features": select(lr((0, "hx_", "ha", "1.0"), (1, "hx_", "hb", "1.0"), (2, "hx_", str(CONSTANT_HASH), "1.0")), TOKENS),
        "weighted_keep": select(lr((0, "hx_", "ha", "1.5"), (1, "(fl join ex using (ex))", "hg", "2.0")), TOKENS, FLAGS),
        "linear_terms": select(lr((0, "hx_", "ha", "2.0"), (1, "hx_", fnv("hb", "hc"), "0.5")), TOKENS),
        "constant_feature": select(lr((0, "ex", str(CONSTANT_HASH), "1.0")), BASE),
        "missing_namespace": select(lr((1, "hx_", "ha", "1.0")), TOKENS),
        "fnv_pair": select(lr((0, "hx_", fnv("ha", "hb"), "1.0")), TOKENS),
        "fnv_triple": select(lr((0, "hx_", fnv("ha", "hb", "hc"), "2.0")), TOKENS),
        "multi_value_interaction": select(lr((0, "(select ex, ha, hg from hx_ join fl using (ex))", fnv("ha", "hg"), "1.0")), TOKENS, FLAGS),
        "float_as_category": select(lr((0, "(select ex, h from ex join he_bal on v = bal::varchar)", "h", "1.0")), BASE, float_hash),
        "binner_sqrt_plain": transformed(binner("sqrt", 1000, 2, False, "price")),
        "binner_sqrt_interp": transformed(binner("sqrt", 1000, 1, True, "price")),
        "binner_log_plain": transformed(binner("log", 0, 10, False, "price")),
        "binner_log_interp": transformed(binner("log", 0, 1, True, "price")),
        "logratio_plain": transformed(ratio(10, 100, False)),
        "logratio_interp": transformed(ratio(10, 1, True)),
        "combine2": combined("hx_", "xor(ha, hb)"),
        "combine3": combined("hx_", "xor(xor(ha, hb), hc)"),
        "combine4": combined("(select hx_.*, h he from hx_ join he_bal on v = bal::varchar)", "xor(xor(xor(ha, hb), hc), he)", source=f"{TOKENS}, {float_hash}"),
        "weight_transform": combined("hx_", "ha", value="2.5"),
        "nested_transform": combined(f"(select *, {int_hash(transform_seeds(0)[0], 'hb')} hu from hx_)", "xor(hu, hc)", 1, value="2.0"),
        "primitive_filter": select(f"select ex, 0::int i, 0::int f, {masked('hb', ffm_mask(18, 3))} h, 1.0::double v from hx_", TOKENS),
        "ffm_features": select("select ex, i, f::int f, h, v::double v from ff", TOKENS, FLAGS, ffm([("ha", "hb"), ("hc",), ("hg",)], 3)),
        "lr_combo_sums": select(f"select ex, combo::int combo, round(sum(v * {w('idx')}), 6) s from lr group by all", *LR),
        "lr_score": select(f"select ex, round(total, 6) total, round({sigmoid('total')}, 6) prediction from tot", *LR, lr_totals()),
        "lr_score_clamped": select(f"select ex, round({sigmoid('total')}, 6) prediction from tot", *LR, lr_totals("200")),
        "ffm_field_vectors": select("select ex, f, z, j, round(c, 6) c from cv", *EMB),
        "ffm_pair_dot": select("select ex, f1, f2, round(o, 6) o from crs", *PAIRS),
        "ffm_diagonal": select("select ex, f1, round(o, 6) o from dg", *PAIRS),
        "triangle": select("select ex, (f2 * (f2 + 1) // 2 + f1)::int slot, round(o, 6) v from (select ex, f1, f2, o from crs union all select ex, f1, f1, o from dg)", *PAIRS),
        "ffm_score": select(f"select ex, round({sigmoid('total')}, 6) prediction from fft", *PAIRS, FFM_TOTAL),
        "lr_plus_ffm_score": select(f"select ex, round(t, 6) total, round({sigmoid('t')}, 6) prediction from (select ex, tot.total + fft.total t from tot join fft using (ex))", *PAIRS, FFM_TOTAL, LR_PARTS, lr_totals()),
        "context_cache_score": select(f"select ex, round({sigmoid('t')}, 6) prediction from (select ex, fft.total + {w(masked('ha', h18))} + {w(masked('hc', h18))} t from fft join hx_ using (ex))", *PAIRS, FFM_TOTAL),
        "relu_layer": select(f"{ELEMENT} (select vec_id, n, list_transform(x, lambda v: greatest(v, 0.0)) y from vec)", VECTORS),
        "normalize_predict": select(f"{ELEMENT} (select vec_id, n, list_transform(x, lambda v: v / sqrt((list_sum(list_transform(x, lambda u: pow(m * m - u, 2))) + 0.01) / n)) y from (select *, list_sum(x) / n m from vec))", VECTORS),
        "normalize_learn": select(f"{ELEMENT} (select vec_id, n, list_transform(x, lambda v: (v - m) / sqrt((list_sum(list_transform(x, lambda u: pow(m * m - u, 2))) + 0.01) / n)) y from (select *, list_sum(x) / n m from vec))", VECTORS),
        "sum_block": select("select vec_id, round(list_sum(x), 6) total from vec where n = 64", VECTORS),
        "nn_forward": nn_forward(),
        "logloss_gradient": select("select ex, round(case when abs(total) > 50 then 0 else p - label end, 6) g from sc", *SCORED),
        "minibatch_gradient": select("select idx, round(g, 6) g, round(s, 6) s from gr", *GRADS),
        "sgd_step": step("sgd"),
        "adagrad_flex_step": step("adagrad_flex"),
        "adagrad_lut_step": step("adagrad_lut"),
        "logloss_metric": select("select round(avg(-ln(greatest(1e-15, case label when 1 then p else 1 - p end))), 6) logloss from lb", *LABELLED),
        "confusion_metrics": select(
            """select tp, fp, fn, tn, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(tn / (tn + fp), 6) specificity, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) f1,
            round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) balanced_accuracy, round(logloss, 6) logloss from (select count(*) filter (label = 1 and p >= 0.5) tp, count(*) filter (label = 0 and p >= 0.5) fp, count(*) filter (label = 1 and p < 0.5) fn,
            count(*) filter (label = 0 and p < 0.5) tn, avg(-ln(case label when 1 then p else 1 - p end + 10e-8)) logloss from lb)""",
            *LABELLED,
        ),
        "distinct_predictions": select("select count(*) n, count(distinct round(p, 6)) distinct_n from lb", *LABELLED),
        "running_loss": select("select ex, round(avg(-ln(greatest(1e-15, case label when 1 then p else 1 - p end))) over (order by ex rows unbounded preceding), 6) mean_loss from lb", *LABELLED),
        "sequential_linear": in_order(),
        "delayed_linear": in_order(delay=100),
        "many_models_linear": in_order(by="(ex % 8)::varchar"),
        "warm_start_linear": in_order(shown="ex > (select floor(max(ex) / 2) from ex)", decimals=4),
        "predictions_after_filter": in_order(shown="ex > 1000"),
        "update_flags": in_order("case when ex % 10 = 0 then 0.0 else 1.0 end", "ex < 1000"),
        "minibatch_linear": select(
            "select idx, round(w1 - 0.001 * sum(g2), 6) w from gr2 group by idx, w1",
            TOKENS,
            f"two as (select ex, label, {masked('ha', h18)} idx from hx_ union all select ex, label, {masked('hb', h18)} from hx_)",
            "one as (select idx, -0.001 * sum(0.5 - label) w1 from two group by idx)",
            f"sc2 as (select ex, {sigmoid('sum(w1)')} p from two join one using (idx) group by ex)",
            "gr2 as (select idx, w1, p - label g2 from two join one using (idx) join sc2 using (ex))",
        ),
        "model_save_load": select(f"select ex, round({stored_model()}, 4) prediction from hx_", TOKENS),
        "sql_predict": select(f"select ex, case when ex % 7 = 0 then -1.0 else round({stored_model()}, 4) end prediction from hx_", TOKENS),
        "record_cache": select("select ex, 1::int label, 1::int n_a, 1::int n_b from ex", BASE),
        "stream_score": select(f"select ex, case when ex % 7 = 0 then 'ERR: Feature name was not predeclared in vw_namespace_map.csv: Z' else printf('%.4f', round({stored_model()}, 4)) end response from hx_", TOKENS),
        "hot_swap": select(f"select ex, printf('%.4f', round({stored_model(second=False)}, 4)) before, printf('%.4f', round({stored_model('500', False)}, 4)) after, 'hogwild_load success' answer from hx_", TOKENS),
        "prediction_format": select("select ex, printf('%.6f', round(p, 6)) line from sc", *SCORED),
        "weight_stats": "select round(min(x), 4) min_w, round(max(x), 4) max_w, round(avg(x) filter (c_custkey % 10 = 0), 6) mean_w, abs(avg(x) filter (c_custkey % 10 = 0)) > 10 skewed from (select c_custkey, c_acctbal / 1000 x from customer)",
        "dequantize": "select p_partkey idx, round((-0.5 + p_size * 0.25)::double, 6) w from part",
        # Half precision has eleven significant bits, ties to even.
        "quantize_roundtrip": select(
            "select idx, half::bigint bucket, round((low + (half::float * inc)::float)::float::double, 6) w from halved",
            "bounds as (select low, ((high - low)::float / 65025::float)::float inc from (select round(min(c_acctbal / 1000), 4)::float low, round(max(c_acctbal / 1000), 4)::float high from customer))",
            "buckets as (select c_custkey idx, low, inc, round(((c_acctbal / 1000)::float - low)::float::double / inc::double) k from customer, bounds)",
            "halved as (select *, case when k < 2048 then k else round_even(k / pow(2, floor(log2(k)) - 10), 0) * pow(2, floor(log2(k)) - 10) end half from buckets)",
        ),
        "weight_diff": "select pos, pos - coalesce(lag(pos) over (order by pos), 0) delta, b new from (select o_orderkey pos, ((o_orderkey * 31 % 256 + 1) % 256)::int b from orders where o_orderkey % 7 = 0)",
        "weight_diff_apply": "select o_orderkey pos, case when o_orderkey % 7 = 0 then (o_orderkey * 31 % 256 + 1) % 256 else o_orderkey * 31 % 256 end::int b from orders",
        "inference_convert": f"select 'lr' block, p_partkey idx, round({w('p_partkey')}, 6) w from part",
        "model_averaging": f"select idx, round(sum(x * (part + 1) / 10)::float::double, 6) w from (select o_orderkey % 4 part, o_custkey % 1000 idx, max({w('o_custkey')}) x from orders group by all) group by idx",
        "event_windows": "select strftime(ts, '%Y-%m-%d') \"day\", event_type, count(*) n, round(sum(\"value\"), 2) total from events group by all",
    }
    # No negative zeros, as in the engine's results.
    return {name: re.sub(r"round\((\w+|unnest\(y\)), 6\)", r"(round(\1, 6) + 0)", sql) for name, sql in out.items()}
