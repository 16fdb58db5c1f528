"""Lines to examples and to features, whole Arrow batches at a time.

The grammar is that of text.py. Words, namespaces, weights and hashes of all lines
of a batch are found by numpy over their bytes. Lines that are out of the ordinary
(commands, errors, numbers of odd spellings) are read one by one by local.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import CONSTANT_HASH, FNV_PRIME, M32, MASK31, ffm_mask, lr_mask, murmur3_spans
from ..plans.spec import ModelSpec
from . import local
from .catalog import Catalog

SPACE, BAR, COLON = 0x20, 0x7C, 0x3A
NUMBER = r"^[+-]?[0-9]{1,18}(\.[0-9]{0,18})?([eE][+-]?[0-9]{1,2})?$"
FEATURE = pa.struct([("hash", pa.int64()), ("weight", pa.float32()), ("fval", pa.float32())])


@dataclass
class Column:
    """Features of a namespace: how many each line has, and theirs one after the other."""

    count: np.ndarray
    hash: np.ndarray
    weight: np.ndarray
    fval: np.ndarray


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes()))


def _floats(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, and which of them are plainly spelled."""
    plain = pc.match_substring_regex(text, NUMBER)
    value = pc.cast(pc.if_else(plain, text, pa.scalar("0")), pa.float64())
    return np.asarray(value).astype(np.float32), np.asarray(plain)


def parse_lines(lines: pa.Array, catalog: Catalog, columns: list[str]) -> tuple[dict[str, pa.Array], dict[str, Column]]:
    """label, importance, command, argument, error of lines, and features of the wanted columns."""
    lines = lines.fill_null("").cast(pa.string())
    n = len(lines)
    ends = np.frombuffer(lines.buffers()[1], np.int32, n + 1, lines.offset * 4).astype(np.int64)
    raw = lines.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: ends[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    first, last = ends[:-1], ends[1:]
    solid = data != SPACE
    solid[: ends[0]] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1  # words
    line = np.searchsorted(last, begin, "right")
    word_at = np.searchsorted(begin, ends)
    head = np.where(last > first, data[np.minimum(first, max(len(data) - 1, 0))] if len(data) else 0, 0)
    odd = ~np.isin(head, np.frombuffer(b"1-|", np.uint8))
    is_ns = data[begin] == BAR if len(begin) else np.zeros(0, bool)
    colons = np.flatnonzero(data == COLON)
    colon = np.append(colons, len(data) + 1)[np.searchsorted(colons, begin)]
    weighted = colon < stop
    name_stop = np.where(weighted, colon, stop)
    index = np.arange(len(begin))
    ns_of = np.maximum.accumulate(np.where(is_ns, index, -1)) if len(begin) else index
    ns_of = np.where(ns_of >= word_at[:-1][line], ns_of, -1) if len(begin) else index

    label = np.where(head == ord("1"), 1, 0)
    has_label = (head == ord("1")) | (head == ord("-"))
    importance = np.ones(n, np.float32)
    given = np.flatnonzero((index == word_at[:-1][line] + 1) & ~is_ns & has_label[line]) if len(begin) else index
    if len(given):
        value, plain = _floats(_strings(data, begin[given], stop[given]))
        importance[line[given]] = value
        odd[line[given][~plain | (value < 0)]] = True

    number = {ns.name: i for i, ns in enumerate(catalog.namespaces)}  # the last of a name counts
    heads = np.flatnonzero(is_ns)
    names = _strings(data, begin[heads] + 1, np.maximum(name_stop[heads], begin[heads] + 1))
    keys = pa.array(list(number), pa.string())
    found = pc.index_in(names, keys) if len(keys) else pa.nulls(len(names), pa.int32())
    known = np.asarray(found.is_valid())
    odd[line[heads][~known]] = True
    ns_id = np.full(len(begin) + 1, -1)
    ns_id[heads] = np.where(known, np.array([*number.values(), -1])[np.asarray(found.fill_null(len(number)))], -1)
    ns_weight = np.ones(len(begin) + 1, np.float32)
    own = heads[weighted[heads]]
    if len(own):
        value, plain = _floats(_strings(data, colon[own] + 1, stop[own]))
        ns_weight[own] = value
        odd[line[own][~plain]] = True
    # Of namespaces that a line declares again, the last counts.
    last_head = np.zeros(len(begin) + 1, bool)
    if len(heads):
        key = line[heads] * (len(catalog.namespaces) + 1) + ns_id[heads]
        order = np.lexsort((heads, key))
        final = np.append(key[order][1:] != key[order][:-1], True)
        last_head[heads[order[final]]] = True

    feature = np.flatnonzero(~is_ns & (ns_of >= 0)) if len(begin) else index
    weight = np.ones(len(feature), np.float32)
    own = np.flatnonzero(weighted[feature])
    if len(own):
        value, plain = _floats(_strings(data, colon[feature[own]] + 1, stop[feature[own]]))
        weight[own] = value
        odd[line[feature[own]][~plain]] = True
    owner = ns_of[feature]
    every: dict[str, Column] = {}
    for ns in catalog.namespaces:
        if catalog.by_name(ns.name) is not ns:
            continue
        mine = np.flatnonzero(ns_id[owner] == number[ns.name])
        f = feature[mine]
        total = ns_weight[owner[mine]] * weight[mine]
        fval = np.full(len(mine), np.nan, np.float32)
        if ns.is_float and len(mine):
            odd[line[f][total != 1.0]] = True
            begins = np.minimum(begin[f] + catalog.skip_prefix, name_stop[f])
            text = begins < name_stop[f]
            value, plain = _floats(_strings(data, begins[text], name_stop[f][text]))
            fval[text] = value
            odd[line[f[text]][~plain]] = True
            total = np.ones(len(mine), np.float32)
        if ns.column in columns:
            kept = np.flatnonzero(last_head[owner[mine]])
            f = f[kept]
            hashed = murmur3_spans(data, begin[f], name_stop[f], ns.seed) & np.uint32(MASK31)
            every[ns.column] = Column(np.bincount(line[f], minlength=n), hashed.astype(np.int64), total[kept], fval[kept])

    state = {"label": label, "has": has_label, "importance": importance, "no_importance": np.zeros(n, bool)}
    command, argument, error = [None] * n, [None] * n, [None] * n
    odd_lines = np.flatnonzero(odd)
    if len(odd_lines):
        _read_odd(lines, odd_lines, catalog, every, state, command, argument, error)
    return {
        "label": pa.array(state["label"].astype(np.int32), mask=~state["has"]),
        "importance": pa.array(state["importance"], mask=state["no_importance"]),
        "command": pa.array(command, pa.string()),
        "argument": pa.array(argument, pa.string()),
        "error": pa.array(error, pa.string()),
    }, every


def _read_odd(lines: pa.Array, odd: np.ndarray, catalog: Catalog, every: dict[str, Column], state: dict, command: list, argument: list, error: list) -> None:
    """Reads some lines again, one by one, and puts what they hold in place of what was found."""
    again: dict[str, dict[int, list]] = {c: {} for c in every}
    for i in odd.tolist():
        for c in every:
            again[c][i] = []
        line = lines[i].as_py()
        state["has"][i] = line[:1] in ("1", "-") and line[:1] != ""
        state["label"][i] = int(line[:1] == "1")
        try:
            label, importance, found = local.parse_line(line, catalog)
        except local.Command as e:
            command[i], argument[i] = e.name, e.argument
            state["importance"][i] = 1.0
            continue
        except local.ParseError as e:
            error[i] = str(e)
            given = local.given_importance(line)
            state["importance"][i], state["no_importance"][i] = (1.0, True) if given is None else (given, False)
            continue
        state["importance"][i] = importance
        for c in every:
            again[c][i] = found.get(c, [])
    for c, x in every.items():
        at = np.concatenate([[0], np.cumsum(x.count)])
        drop = np.zeros(at[-1], bool)
        for i in odd.tolist():
            drop[at[i] : at[i + 1]] = True
        row = np.repeat(np.arange(len(x.count)), x.count)[~drop]
        more = [(i, *f) for i, fs in again[c].items() for f in fs]
        if more:
            m = np.array([r[0] for r in more])
            new = [np.array([r[1] for r in more], np.int64), np.array([r[2] for r in more], np.float32), np.array([np.nan if r[3] is None else r[3] for r in more], np.float32)]
        else:
            m, new = np.zeros(0, np.int64), [np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)]
        order = np.argsort(np.concatenate([row, m]), kind="stable")
        h, w, f = (np.concatenate([old[~drop], y])[order] for old, y in zip((x.hash, x.weight, x.fval), new, strict=True))
        every[c] = Column(np.bincount(np.concatenate([row, m]), minlength=len(x.count)).astype(np.int64), h, w, f)


def _list(count: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), values)


def parse(lines: DataFrame, catalog: Catalog, key: str = "example_num", line: str = "line", columns: list[str] | None = None) -> DataFrame:
    """The same as text.parse, by Arrow batches. columns: those of the namespaces that are wanted, by default all."""
    namespaces = [ns for ns in catalog.namespaces if catalog.by_name(ns.name) is ns and (columns is None or ns.column in columns)]
    wanted = [ns.column for ns in namespaces]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, every = parse_lines(batch.column(1), catalog, wanted)
            out = [batch.column(0), *state.values()]
            for ns in namespaces:
                x = every[ns.column]
                fval = pa.array(x.fval) if ns.is_float else pa.nulls(len(x.hash), pa.float32())
                out.append(_list(x.count, pa.StructArray.from_arrays([pa.array(x.hash), pa.array(x.weight), fval], fields=list(FEATURE))))
            yield pa.RecordBatch.from_arrays(out, ["example_num", *state, *wanted])

    schema = "example_num long, label int, importance float, command string, argument string, error string" + "".join(f", {c} array<struct<hash:bigint,weight:float,fval:float>>" for c in wanted)
    return lines.select(F.col(key).cast("long").alias("example_num"), F.col(line).alias("line")).mapInArrow(run, schema)


# Features


def _product(left: tuple, right: Column, starts: np.ndarray) -> tuple:
    """All pairs of a row's features, the left ones' order first: rows, hashes, values."""
    row, h, v = left
    times = right.count[row]
    total = int(times.sum())
    at = np.repeat(np.arange(len(row)), times)
    inner = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    other = starts[row[at]] + inner
    return row[at], right.hash[other] ^ (h[at] * FNV_PRIME & M32), v[at] * right.weight[other]


def combine(every: dict[str, Column], spec: ModelSpec, n: int) -> tuple[tuple, tuple]:
    """Linear and field features of n rows: counts, hashes, values, and combinations' or fields' numbers."""
    mask, parts = lr_mask(spec.bit_precision), []
    starts = {c: np.cumsum(x.count) - x.count for c, x in every.items()}
    rows = lambda c: np.repeat(np.arange(n), every[c].count)
    for i, combo in enumerate(spec.combos):
        c = combo.columns[0]
        found = rows(c), every[c].hash, every[c].weight
        for c in combo.columns[1:]:
            found = _product(found, every[c], starts[c])
        parts.append((found[0], found[1] & mask, found[2] * np.float32(combo.weight), np.full(len(found[0]), i, np.int32)))
    if spec.constant:
        parts.append((np.arange(n), np.full(n, CONSTANT_HASH & mask), np.ones(n, np.float32), np.full(n, len(spec.combos), np.int32)))
    fields, fmask = [], ffm_mask(spec.ffm_bit_precision, spec.ffm_k)
    for i, columns in enumerate(spec.fields if spec.ffm_k else ()):
        for c in columns:
            fields.append((rows(c), every[c].hash & fmask, every[c].weight, np.full(len(every[c].hash), i, np.int32)))
    out = []
    for some in (parts, fields):
        if not some:
            some = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int32))]
        row, h, v, k = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(row, kind="stable")
        out.append((np.bincount(row, minlength=n).astype(np.int64), h[order].astype(np.int64), v[order].astype(np.float32), k[order]))
    return out[0], out[1]


FEATURES = "example_num long, label int, importance float, {more}lr array<struct<hash:bigint,value:float,combo:int>>, ffm array<struct<hash:bigint,value:float,field:int>>"


def feature_lists(every: dict[str, Column], spec: ModelSpec, n: int) -> list[pa.ListArray]:
    """lr and ffm of n rows."""
    sets = combine(every, spec, n)
    return [_list(count, pa.StructArray.from_arrays([pa.array(h), pa.array(v), pa.array(k)], ["hash", "value", third])) for (count, h, v, k), third in zip(sets, ("combo", "field"), strict=True)]


def featurize(lines: DataFrame, spec: ModelSpec, key: str = "example_num", line: str = "line") -> DataFrame:
    """example_num, label, importance, error, command, lr, ffm: lines parsed and combined in one pass. For specifications without transforms."""
    if spec.transforms:
        raise ValueError("transforms are columns: parse, then featurize")
    wanted = spec.used_columns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, every = parse_lines(batch.column(1), spec.catalog, wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0), state["label"], state["importance"], state["error"], state["command"], *feature_lists(every, spec, batch.num_rows)], ["example_num", "label", "importance", "error", "command", "lr", "ffm"])

    return lines.select(F.col(key).cast("long").alias("example_num"), F.col(line).alias("line")).mapInArrow(run, FEATURES.format(more="error string, command string, "))


def featurize_examples(examples: DataFrame, spec: ModelSpec) -> DataFrame:
    """example_num, label, importance, lr, ffm of parsed examples, as from a cache: hashes and weights of the used namespaces are read and combined, no text. For specifications without transforms."""
    if spec.transforms:
        raise ValueError("transforms are columns: use operators.features.featurize")
    wanted = spec.used_columns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = {}
            for k, c in enumerate(wanted):
                count = pc.fill_null(pc.list_value_length(batch.column(2 * k + 3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                h, w = (batch.column(2 * k + 3 + j).flatten().to_numpy(zero_copy_only=False) for j in (0, 1))
                every[c] = Column(count, h, w, w)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *feature_lists(every, spec, batch.num_rows)], ["example_num", "label", "importance", "lr", "ffm"])

    lists = [F.col(c)[part].alias(f"{c}_{part}") for c in wanted for part in ("hash", "weight")]
    return examples.select("example_num", "label", "importance", *lists).mapInArrow(run, FEATURES.format(more=""))
