"""A model's specification: feature combinations, fields, hashing, optimizers and layers, and its options."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from ..sources.catalog import Catalog, Namespace
from .dsl import DslError, Transform, resolve

#: Limits of factorization.
MAX_K, MAX_CONTRA = 128, 41472


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Combo:
    """Columns of namespaces whose features are combined, and a factor of their values."""

    columns: tuple[str, ...]
    weight: float = 1.0


@dataclass(frozen=True)
class Rates:
    learning_rate: float = 0.5
    power_t: float = 0.5
    init_acc: float = 1.0


@dataclass(frozen=True)
class Layer:
    width: int = 20
    activation: str = "none"
    layernorm: str = "none"
    maxnorm: float = 0.0
    dropout: float = 0.0
    init: str = "hu"


@dataclass
class ModelSpec:
    catalog: Catalog
    combos: list[Combo] = field(default_factory=list)
    fields: list[tuple[str, ...]] = field(default_factory=list)
    transforms: list[Transform] = field(default_factory=list)
    bit_precision: int = 18
    ffm_k: int = 0
    ffm_bit_precision: int = 18
    constant: bool = True
    optimizer: str = "sgd"
    lr: Rates = Rates()
    ffm: Rates = Rates()
    nn: Rates = Rates()
    ffm_init: tuple[float, float, float] = (0.0, 0.0, 0.0)
    layers: list[Layer] = field(default_factory=list)
    topology: str = "one"
    dequantize: bool = False

    @property
    def n_combos(self) -> int:
        return len(self.combos) + self.constant

    @property
    def n_fields(self) -> int:
        return len(self.fields) if self.ffm_k else 0

    def float_columns(self) -> set[str]:
        return {n.column for n in self.catalog.namespaces if n.is_float}

    def used_columns(self) -> list[str]:
        """Columns of primitive namespaces that the model reads."""
        used = {c for combo in self.combos for c in combo.columns} | {c for f in self.fields for c in f}
        for t in reversed(self.transforms):
            if t.column in used:
                used |= {self.column_of(s) for s in t.sources}
        return [n.column for n in self.catalog.namespaces if n.column in used and self.catalog.by_name(n.name) is n]

    def column_of(self, verbose: str) -> str:
        ns = self.catalog.by_verbose(verbose)
        if ns is not None:
            return ns.column
        for t in self.transforms:
            if t.name == verbose:
                return t.column
        raise SpecError(f"Unknown verbose namespace in command line: {verbose}")

    def to_json(self) -> str:
        x = asdict(self)
        x["catalog"] = json.loads(self.catalog.to_json())
        return json.dumps(x, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ModelSpec:
        x = json.loads(text)
        x["catalog"] = Catalog.from_json(json.dumps(x["catalog"]))
        x["combos"] = [Combo(tuple(c["columns"]), c["weight"]) for c in x["combos"]]
        x["fields"] = [tuple(f) for f in x["fields"]]
        x["transforms"] = [Transform(t["name"], t["function"], tuple(t["sources"]), tuple(t["params"]), t["index"], t["statement"]) for t in x["transforms"]]
        for k in ("lr", "ffm", "nn"):
            x[k] = Rates(**x[k])
        x["ffm_init"] = tuple(x["ffm_init"])
        x["layers"] = [Layer(**y) for y in x["layers"]]
        return cls(**x)


def _valued(text: str) -> tuple[str, float]:
    name, *rest = text.split(":")
    if len(rest) > 1:
        raise SpecError(f'only one value parameter allowed (denoted with ":"): "{text}"')
    try:
        return name, float(rest[0]) if rest else 1.0
    except ValueError:
        raise SpecError(f"Could not parse the value of a feature combination: {rest[0]}") from None


def _by_letter(catalog: Catalog, letters: str) -> tuple[str, ...]:
    found = []
    for c in letters:
        ns: Namespace | None = catalog.by_name(c)
        if ns is None:
            raise SpecError(f"Unknown namespace char in command line: {c}")
        found.append(ns.column)
    return tuple(found)


def parser() -> argparse.ArgumentParser:
    """All options. Some have no effect, for compatibility: quiet, minimum_learning_rate, ffm_k_threshold, foreground."""
    p = argparse.ArgumentParser(prog="sparsemill", allow_abbrev=False, description="Sparse-feature models: logistic regression, factorization machines, small nets")
    add = p.add_argument
    add("-d", "--data")
    add("-p", "--predictions")
    add("-c", "--cache", action="store_true")
    add("-f", "--final_regressor")
    add("-i", "--initial_regressor")
    add("-t", "--testonly", action="store_true")
    for name in ("quiet", "save_resume", "build_cache_without_training", "sgd", "adaptive", "noconstant", "vwcompat", "daemon", "foreground", "hogwild_training", "weight_quantization", "predictions_stdout"):
        add(f"--{name}", action="store_true")
    for name in ("interactions", "linear", "keep", "transform", "ffm_field", "ffm_field_verbose", "nn"):
        add(f"--{name}", action="append", default=[])
    add("-l", "--learning_rate", type=float)
    add("-b", "--bit_precision", type=int)
    for name in ("ffm_learning_rate", "nn_learning_rate", "minimum_learning_rate", "power_t", "ffm_power_t", "nn_power_t", "l2", "ffm_k_threshold", "ffm_init_center", "ffm_init_width", "ffm_init_zero_band", "nn_init_acc_gradient", "ffm_init_acc_gradient", "init_acc_gradient"):
        add(f"--{name}", type=float)
    for name in ("ffm_k", "ffm_bit_precision", "nn_layers", "port", "num_children", "prediction_model_delay", "predictions_after", "holdout_after", "hogwild_threads"):
        add(f"--{name}", type=int)
    for name in ("link", "loss_function", "hash", "convert_inference_regressor", "nn_topology", "ffm_initialization_type"):
        add(f"--{name}")
    return p


def _or(value, default):  # noqa: ANN001, ANN202
    return default if value is None else value


def from_options(options: argparse.Namespace, catalog: Catalog) -> ModelSpec:
    o = options
    spec = ModelSpec(catalog)
    acc = 1.0
    fast = True
    if o.vwcompat:
        acc, fast = 0.0, False
        for ok, what in ((o.keep, "--vwcompat requires at least one --keep parameter"), (o.hash == "all", "--vwcompat requires use of --hash all"), (o.sgd, "--vwcompat requires use of --sgd")):
            if not ok:
                raise SpecError(what)
    for flag in ("link", "loss_function"):
        if getattr(o, flag) not in (None, "logistic"):
            raise SpecError(f"--{flag} only supports 'logistic'")
    if abs(_or(o.l2, 0.0)) > 1e-8:
        raise SpecError("--l2 can only be 0.0")
    if o.ffm_initialization_type not in (None, "default"):
        raise SpecError("Please select a valid initialization type: default")
    try:
        spec.transforms = resolve(o.transform, catalog)
    except DslError as e:
        raise SpecError(str(e)) from None
    for text in (*o.keep, *o.interactions):
        letters, weight = _valued(text)
        spec.combos.append(Combo(_by_letter(catalog, letters), weight))
    for text in o.linear:
        names, weight = _valued(text)
        spec.combos.append(Combo(tuple(spec.column_of(n) for n in names.split(",")), weight))
    if o.ffm_k:
        if o.ffm_k > MAX_K:
            raise SpecError(f"Maximum ffm_k is: {MAX_K}, passed: {o.ffm_k}")
        spec.ffm_k = o.ffm_k
    for text in o.ffm_field:
        if ":" in text:
            raise SpecError(f'Fields currently do not support passing a value via : "{text}"')
        spec.fields.append(_by_letter(catalog, text))
    for text in o.ffm_field_verbose:
        if ":" in text:
            raise SpecError(f'Fields currently do not support passing a value via : "{text}"')
        spec.fields.append(tuple(spec.column_of(n) for n in text.split(",")))
    if spec.ffm_k and spec.ffm_k * len(spec.fields) ** 2 > MAX_CONTRA:
        raise SpecError(f"k * fields^2 is over {MAX_CONTRA}")
    spec.bit_precision, spec.ffm_bit_precision = _or(o.bit_precision, 18), _or(o.ffm_bit_precision, 18)
    spec.lr = Rates(_or(o.learning_rate, 0.5), _or(o.power_t, 0.5), _or(o.init_acc_gradient, acc))
    spec.ffm = Rates(_or(o.ffm_learning_rate, spec.lr.learning_rate), _or(o.ffm_power_t, spec.lr.power_t), _or(o.ffm_init_acc_gradient, spec.lr.init_acc))
    spec.nn = Rates(_or(o.nn_learning_rate, spec.ffm.learning_rate), _or(o.nn_power_t, spec.ffm.power_t), _or(o.nn_init_acc_gradient, spec.ffm.init_acc))
    spec.ffm_init = (_or(o.ffm_init_center, 0.0), _or(o.ffm_init_width, 0.0), _or(o.ffm_init_zero_band, 0.0))
    spec.constant = not o.noconstant
    spec.optimizer = ("adagrad_lut" if fast else "adagrad_flex") if o.adaptive else "sgd"
    spec.layers = [Layer() for _ in range(_or(o.nn_layers, 0))]
    spec.topology = _or(o.nn_topology, "one")
    if spec.layers and spec.topology not in ("one", "two", "four", "five"):
        raise SpecError(f'unknown nn topology: "{spec.topology}"')
    for text in o.nn:
        parts = text.split(":")
        if len(parts) != 3:
            raise SpecError(f'--nn parameters have to be of form layer:parameter_name:parameter_value: "{text}"')
        number, name, value = int(parts[0]), parts[1], parts[2]
        if number >= len(spec.layers):
            raise SpecError(f"--nn parameter addressing layer {number}, but we have only {len(spec.layers)} layers")
        allowed = {"activation": ("none", "relu"), "layernorm": ("none", "before", "after"), "init": ("xavier", "hu", "one", "zero")}
        if name in allowed:
            if value not in allowed[name]:
                raise SpecError(f'unknown nn {name}: "{value}"')
            spec.layers[number] = replace(spec.layers[number], **{name: value})
        elif name in ("width", "maxnorm", "dropout"):
            spec.layers[number] = replace(spec.layers[number], **{name: (int if name == "width" else float)(value)})
        else:
            raise SpecError(f"Unknown --nn parameter for layer number {number} : {name}")
    if any(x.dropout for x in spec.layers):
        raise SpecError("dropout is not supported")
    return spec


def from_args(args: Sequence[str] | str, catalog: Catalog) -> ModelSpec:
    return from_options(parser().parse_args(args.split() if isinstance(args, str) else list(args)), catalog)
