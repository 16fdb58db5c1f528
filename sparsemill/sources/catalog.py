"""The namespace catalog: which namespaces examples may have, their order and formats."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import namespace_seed

#: Fixed values.
FILE_NAME = "vw_namespace_map.csv"
SKIP_PREFIX = "_namespace_skip_prefix"


@dataclass(frozen=True)
class Namespace:
    name: str
    verbose: str
    index: int
    is_float: bool = False

    @property
    def seed(self) -> int:
        return namespace_seed(self.name)

    @property
    def column(self) -> str:
        return f"ns_{self.name}"


@dataclass
class Catalog:
    """Namespaces by name and by verbose name; of rows that repeat a verbose name the last counts."""

    namespaces: list[Namespace] = field(default_factory=list)
    skip_prefix: int = 0

    @classmethod
    def from_rows(cls, rows: Iterable[tuple]) -> Catalog:
        """rows: name, verbose name, and "f32", "" or nothing."""
        out = cls()
        for index, row in enumerate(rows):
            row = [str(x).strip() for x in row]
            if row[0] == SKIP_PREFIX:
                out.skip_prefix = int(row[1])
                continue
            kind = row[2] if len(row) > 2 else ""
            if kind not in ("", "f32"):
                raise ValueError(f'Unknown type used for the feature in {FILE_NAME}: "{kind}". Only "f32" is possible.')
            out.namespaces.append(Namespace(row[0], row[1], index, kind == "f32"))
        return out

    @classmethod
    def read(cls, path: str, spark: SparkSession | None = None) -> Catalog:
        """From a csv file, or the one in a dataset's directory. Given a session, read through Spark, from any store it reaches."""
        if spark is not None:
            path = path if path.endswith(".csv") else f"{path.rstrip('/')}/{FILE_NAME}"
            lines = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
            return cls.from_rows(r for r in csv.reader(lines.splitlines()) if r)
        with open(path if path.endswith(".csv") else os.path.join(path, FILE_NAME), newline="", encoding="utf-8") as f:
            return cls.from_rows(r for r in csv.reader(f) if r)

    @property
    def num_namespaces(self) -> int:
        return max((n.index for n in self.namespaces), default=-1) + 1

    def by_name(self, name: str) -> Namespace | None:
        return next((n for n in reversed(self.namespaces) if n.name == name), None)

    def by_verbose(self, verbose: str) -> Namespace | None:
        return next((n for n in reversed(self.namespaces) if n.verbose == verbose), None)

    def to_json(self) -> str:
        return json.dumps({"skip_prefix": self.skip_prefix, "namespaces": [[n.name, n.verbose, n.index, n.is_float] for n in self.namespaces]})

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        x = json.loads(text)
        return cls([Namespace(*n) for n in x["namespaces"]], x["skip_prefix"])

    def table(self, spark: SparkSession) -> DataFrame:
        """name, verbose, ns_index, is_float, seed: as many rows as namespaces."""
        return spark.createDataFrame([(n.name, n.verbose, n.index, n.is_float, n.seed) for n in self.namespaces], "name string, verbose string, ns_index int, is_float boolean, seed long")
