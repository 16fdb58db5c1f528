"""Examples from lines of text: label, importance, and namespaces with weighted tokens.

Grammar: `label [importance] |name[:weight] token[:weight] ... |name ...`, or `|name
...` without a label, or a command. Lines are parsed by column expressions; only the
hashing of tokens runs in Arrow batches. Each namespace is a column of its own, so
that a plan reads and hashes only those that its model uses.

A label is told by its first byte. A namespace that is declared twice in a line
counts as declared last. Blanks part tokens, however many there are. A line that
can't be parsed has its error in the column `error` and no features; `command` and
`argument` hold commands.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import token_hash
from .catalog import Catalog, Namespace

#: What each namespace's column holds.
FEATURES = "array<struct<hash:bigint,weight:float,fval:float>>"
EXTENSIONS = (".vw", ".gz", ".zst")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """example_num (from 1, in the order of the file), line. Plain (.vw), gzip and zstandard files are told by their ending."""
    if not path.endswith(EXTENSIONS):
        raise ValueError(f"Please specify a valid input format ({', '.join(EXTENSIONS)}): {os.path.basename(path)}")
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    # Lines of a block have consecutive ids. Blocks, a row for each, are put in order and their sizes added up.
    blocks = rows.groupBy("_path", "_start").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    order = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("_path", "_start", "_first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_before"))
    return rows.join(before, ["_path", "_start"]).select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("example_num"), "line")


def try_float(text: Column) -> Column:
    """A float; NaN for NONE, null if it can't be read."""
    java = text.rlike("[0-9.][fFdD]$")  # a spelling of Java's alone
    return F.when(text == "NONE", F.lit(float("nan"))).when(~java, text.try_cast("float")).cast("float")


def label(line: Column) -> Column:
    """1 or 0 by the first byte, null without a label."""
    return F.when(line.startswith("1"), 1).when(line.startswith("-"), 0).cast("int")


def importance_text(line: Column) -> Column:
    """What stands between a label and the first namespace, null if nothing does."""
    return F.when(line.startswith("1") | line.startswith("-"), F.nullif(F.regexp_extract(line, r"^[^ ]+ +([^ |][^ ]*)", 1), F.lit("")))


def command(line: Column) -> Column:
    """flush, hogwild_load, or null."""
    return F.when(line.startswith("flush"), "flush").when(line.rlike(r"^hogwild_load [^ ]+ *$"), "hogwild_load")


def sections(line: Column) -> Column:
    """Namespace sections: array of (name, weight text, tokens), in the order of the line."""
    body = F.split(F.concat(F.lit(" "), line), r" +\|")
    parts = F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0)))

    def section(part: Column) -> Column:
        words = F.filter(F.split(part, " "), lambda w: w != "")
        # A name may be missing: "| a" declares the namespace "".
        head = F.when(part.startswith(" ") | (part == ""), F.lit("")).otherwise(F.try_element_at(words, F.lit(1)))
        tokens = F.when(part.startswith(" ") | (part == ""), words).otherwise(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
        return F.struct(F.substring_index(head, ":", 1).alias("name"), F.when(head.contains(":"), F.substring(head, F.length(F.substring_index(head, ":", 1)) + 2, F.lit(1 << 30))).alias("weight"), tokens.alias("tokens"))

    return F.transform(parts, section)


def _name(token: Column) -> Column:
    return F.substring_index(token, ":", 1)


def _after(token: Column) -> Column:
    """What follows the first colon, null without one."""
    return F.when(token.contains(":"), F.substring(token, F.length(_name(token)) + F.lit(2), F.lit(1 << 30)))


def _section_error(s: Column, catalog: Catalog) -> Column:
    """The first error of a section, null if it has none."""
    names = F.array(*[F.lit(n.name) for n in catalog.namespaces])
    floats = [n.name for n in catalog.namespaces if n.is_float]
    is_float = s["name"].isin(*floats) if floats else F.lit(False)
    own = F.when(s["weight"].isNull(), F.lit(1.0)).otherwise(try_float(s["weight"]))

    def token_error(t: Column) -> Column:
        weight = F.when(_after(t).isNull(), F.lit(1.0)).otherwise(try_float(_after(t)))
        value = F.substring(_name(t), F.lit(catalog.skip_prefix + 1), F.lit(1 << 30))
        return (
            F.when(_after(t).isNotNull() & weight.isNull(), F.concat(F.lit("Failed parsing feature weight: "), _after(t)))
            .when(is_float & (value != "") & try_float(value).isNull(), F.concat(F.lit("Failed parsing feature value to float (for float namespace): "), value))
            .when(is_float & (own * weight != 1.0), F.lit("Namespaces that are f32 can not have weight attached neither to namespace nor to a single feature (basically they can' use :weight syntax"))
        )

    tokens = F.filter(F.transform(s["tokens"], token_error), lambda e: e.isNotNull())
    return (
        F.when(s["weight"].isNotNull() & try_float(s["weight"]).isNull(), F.concat(F.lit("Failed parsing namespace weight: "), s["weight"]))
        .when(~F.array_contains(names, s["name"]), F.concat(F.lit("Feature name was not predeclared in vw_namespace_map.csv: "), s["name"]))
        .when(F.size(tokens) > 0, F.try_element_at(tokens, F.lit(1)))
    )


def error(line: Column, found: Column, catalog: Catalog) -> Column:
    """The first error of a line that is no command, null if it has none. found: its sections."""
    given = importance_text(line)
    errors = F.filter(F.transform(found, lambda s: _section_error(s, catalog)), lambda e: e.isNotNull())
    return F.when(
        command(line).isNull(),
        F.when(~line.rlike(r"^[1|\-]"), F.lit("Cannot parse an example"))
        .when(given.isNotNull() & try_float(given).isNull(), F.concat(F.lit("Failed parsing example importance: "), given))
        .when(try_float(given) < 0, F.concat(F.lit("Example importance cannot be negative: "), given, F.lit("! ")))
        .when(F.size(errors) > 0, F.try_element_at(errors, F.lit(1))),
    )


def namespace_features(found: Column, ns: Namespace, catalog: Catalog) -> Column:
    """The column of one namespace: hash, weight and float value of its tokens."""
    own = F.try_element_at(F.filter(found, lambda s: s["name"] == ns.name), F.lit(-1))
    tokens = F.coalesce(own["tokens"], F.array().cast("array<string>"))
    hashes = token_hash(F.transform(tokens, _name), ns.seed)
    weight = F.when(own["weight"].isNull(), F.lit(1.0)).otherwise(try_float(own["weight"])).cast("float")

    def feature(x: Column) -> Column:
        t = x["tokens"]
        if ns.is_float:
            value = F.substring(_name(t), F.lit(catalog.skip_prefix + 1), F.lit(1 << 30))
            fval = F.when(value == "", F.lit(float("nan"))).otherwise(try_float(value))
            return F.struct(x["hashes"].alias("hash"), F.lit(1.0).cast("float").alias("weight"), fval.cast("float").alias("fval"))
        each = F.when(_after(t).isNull(), F.lit(1.0)).otherwise(try_float(_after(t))).cast("float")
        return F.struct(x["hashes"].alias("hash"), (weight * each).cast("float").alias("weight"), F.lit(None).cast("float").alias("fval"))

    return F.transform(F.arrays_zip(tokens.alias("tokens"), hashes.alias("hashes")), feature).cast(FEATURES)


def parse(lines: DataFrame, catalog: Catalog, key: str = "example_num", line: str = "line", prefix: str | None = None) -> DataFrame:
    """key, label, importance, command, argument, error and a column for each namespace, from rows of key and line. prefix: text that stands before each line, as for requests that share a context."""
    rows = lines.select(F.col(key).alias("example_num"), (F.concat(F.lit(prefix), F.col(line)) if prefix else F.col(line)).alias("line"))
    rows = rows.select("example_num", "line", sections(F.col("line")).alias("found"))
    rows = rows.withColumn("error", error(F.col("line"), F.col("found"), catalog))
    good = F.when(F.col("error").isNull() & command(F.col("line")).isNull(), F.col("found")).otherwise(F.slice("found", 1, 0))
    rows = rows.withColumn("found", good)
    own = {n.column: namespace_features(F.col("found"), n, catalog) for n in catalog.namespaces if catalog.by_name(n.name) is n}
    given = importance_text(F.col("line"))
    return rows.select(
        "example_num",
        label(F.col("line")).alias("label"),
        F.when(given.isNull(), F.lit(1.0)).otherwise(try_float(given)).cast("float").alias("importance"),
        command(F.col("line")).alias("command"),
        F.when(command(F.col("line")) == "hogwild_load", F.trim(F.substring_index(F.trim(F.col("line")), " ", -1))).alias("argument"),
        "error",
        *[c.alias(n) for n, c in own.items()],
    )


def _table_features(zipped: Column, is_float: bool) -> Column:
    return F.transform(zipped, lambda x: F.struct(x["h"].alias("hash"), F.lit(1.0).cast("float").alias("weight"), (x["v"] if is_float else F.lit(None)).cast("float").alias("fval"))).cast(FEATURES)


def from_table(rows: DataFrame, key: str, label_col: Column | None, namespaces: dict[str, Column], catalog: Catalog, importance: Column | None = None) -> DataFrame:
    """Examples from a table instead of lines. namespaces: by name, a string or array of strings for a categorical one, a number or array of numbers for a float one."""
    out = [F.col(key).cast("long").alias("example_num"), (label_col if label_col is not None else F.lit(None)).cast("int").alias("label"), (importance if importance is not None else F.lit(1.0)).cast("float").alias("importance")]
    for name, column in namespaces.items():
        ns = catalog.by_name(name)
        if ns is None:
            raise ValueError(f"Feature name was not predeclared in vw_namespace_map.csv: {name}")
        many = F.col(f"_{name}")
        rows = rows.withColumn(f"_{name}", column)
        if not dict(rows.dtypes)[f"_{name}"].startswith("array"):
            many = F.when(many.isNotNull(), F.array(many)).otherwise(F.array().cast(f"array<{dict(rows.dtypes)[f'_{name}']}>"))
        hashes = token_hash(many.cast("array<string>"), ns.seed)
        out.append(_table_features(F.arrays_zip(many.alias("v"), hashes.alias("h")), ns.is_float).alias(ns.column))
    return rows.select(*out)
