"""Settings as tables: statements of several layers, merged by precedence, typed and held against rules.

A statement is a row: scope (whose setting), layer, at (its place within the layer), key (array of names) and value (VARIANT).  ``merged`` keeps for each
scope the statements that nothing hides: one of a higher layer, or of the same layer and a later place, hides every other at its own key, above it and below it, so that
mappings merge name by name while a single value replaces a mapping and a mapping a single value.  YAML files are read by the data source ``settings_yaml``, one
partition a file.

Defined cases: a null scope is a scope of its own; an empty or null key is no statement; null is a value; lists are values and replace one another; two statements at the same
key, layer and place: the larger JSON text wins; a missing file, one that isn't YAML or holds no mapping is one row with ``error`` and no statement.
"""

from __future__ import annotations

import datetime
import glob
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

try:
    import yaml
except ImportError:  # YAML alone needs it
    yaml = None

LAYERS = ("default", "file", "environment", "request")
_LEAVES = "key array<string>, json string, error string"


def _loader() -> type:
    """The safe loader of libyaml where the package has it, which takes a tenth of the time."""
    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def leaves(text: str | None) -> Iterator[tuple[list[str] | None, str | None, str | None]]:
    """(key, JSON, error) of every value of a YAML mapping; an empty mapping is a value."""
    if yaml is None:
        raise ImportError("reading YAML needs the yaml package")
    try:
        found = yaml.load(text or "", _loader())
    except (yaml.YAMLError, ValueError) as e:
        yield None, None, f"not YAML: {str(e).splitlines()[0]}"
        return
    if not isinstance(found, dict):
        yield None, None, "no mapping"
        return
    plain = lambda x: x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)
    stack: list[tuple[list[str], object]] = [([], found)]
    while stack:
        key, value = stack.pop()
        if isinstance(value, dict) and (value or not key):
            stack += [([*key, str(k)], v) for k, v in reversed(value.items())]
        else:
            yield key, json.dumps(value, ensure_ascii=False, default=plain), None


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _YamlReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.path)) or [self.path]]

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            with open(partition.path, encoding="utf-8") as file:
                text = file.read()
        except (OSError, UnicodeDecodeError) as e:
            yield partition.path, None, None, type(e).__name__
            return
        for row in leaves(text):
            yield (partition.path, *row)


class SettingsYaml(DataSource):
    """``spark.read.format("settings_yaml").option("path", glob)``: file, key, json, error.  The files lie where all executors see them."""

    @classmethod
    def name(cls) -> str:
        return "settings_yaml"

    def schema(self) -> str:
        return "file string, " + _LEAVES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _YamlReader(self.options["path"])


def from_yaml(rows: DataFrame, scope: str, text: str) -> DataFrame:
    """scope, key, json, error of YAML texts in a column.  Texts are dealt over all cores: many of them fit into one small file."""
    schema = pa.schema([("scope", pa.string()), ("key", pa.list_(pa.string())), ("json", pa.string()), ("error", pa.string())])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [(s, *leaf) for s, t in zip(*(c.to_pylist() for c in part.columns), strict=True) for leaf in leaves(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True) if made else [[]] * 4, schema, strict=True)], schema=schema)

    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.select(F.col(scope).cast("string"), F.col(text).cast("string")).repartition(4 * cores).mapInArrow(work, "scope string, " + _LEAVES)


def from_environment(variables: DataFrame, prefix: str) -> DataFrame:
    """Statements of variables (scope, name, value) whose names begin with ``prefix``: A__B is the key (a, b); a value that is JSON is that value, any other a text."""
    named = variables.filter(F.startswith("name", F.lit(prefix)))
    key = F.split(F.lower(F.substr("name", F.lit(len(prefix) + 1))), "__")
    value = F.coalesce(F.try_parse_json("value"), F.try_variant_get(F.parse_json(F.to_json(F.struct("value"))), "$.value", "variant"))
    return named.select("scope", F.lit("environment").alias("layer"), F.lit(0).alias("at"), key.alias("key"), value.alias("value"))


def rank(layer: Column) -> Column:
    """The place of a layer in ``LAYERS``; an unknown one is below all."""
    return F.array_position(F.array(*map(F.lit, LAYERS)), layer).cast("int")


def merged(statements: DataFrame) -> DataFrame:
    """scope, key, value, layer of the statements that nothing hides."""
    told = statements.filter(F.coalesce(F.size("key"), F.lit(0)) > 0).select(
        "scope", "key", F.to_json("value").alias("json"), F.struct(F.coalesce(rank(F.col("layer")), F.lit(0)).alias("rank"), "at", F.to_json("value").alias("json")).alias("o"), "layer"
    )
    told = told.groupBy("scope", "key").agg(F.max(F.struct("o", "layer")).alias("best")).select("scope", "key", "best.o", "best.layer")
    # every prefix of a key meets the statement that stands there, and a key meets those below it
    parts = told.select("scope", "key", "o", F.explode(F.sequence(F.lit(1), F.size("key"))).alias("n"))
    parts = parts.select("scope", F.slice("key", F.lit(1), F.col("n")).alias("p"), "o", (F.col("n") == F.size("key")).alias("whole"))
    tops = parts.groupBy("scope", "p").agg(F.max("o").alias("any"), F.max(F.when(F.col("whole"), F.col("o"))).alias("here"))
    wanted = told.select("scope", "key", "o", "layer", F.explode(F.sequence(F.lit(1), F.size("key"))).alias("n")).withColumn("w", F.slice("key", F.lit(1), F.col("n")))
    met = wanted.join(tops.withColumnRenamed("scope", "s"), F.col("scope").eqNullSafe(F.col("s")) & (F.col("w") == F.col("p")))
    last = F.col("n") == F.size("key")
    seen = met.groupBy("scope", "key").agg(F.max(F.when(last, F.col("any")).otherwise(F.col("here"))).alias("top"), F.first("o").alias("o"), F.first("layer").alias("layer"))
    return seen.filter(F.col("top") == F.col("o")).select("scope", "key", F.parse_json("o.json").alias("value"), "layer")


@dataclass(frozen=True)
class Field:
    """A known setting: its type, whether it has to be there, its least and greatest value, the values allowed."""

    type: str
    required: bool = False
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] = ()


def _label(key: str) -> str:
    return key.replace(".", "_")


def typed(settings: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """One row a scope with a column a field, dots as underscores; null where it is missing or not of the type."""
    dotted = F.array_join("key", ".")
    return settings.groupBy("scope").agg(*(F.max(F.when(dotted == k, F.try_variant_get("value", "$", f.type))).alias(_label(k)) for k, f in fields.items()))


def violations(settings: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """scope, key, rule for every rule that a scope's settings break: unknown, type, least, most, allowed, missing."""
    dotted = settings.select("scope", F.array_join("key", ".").alias("key"), "value")
    broken = F.when(~F.col("key").isin(*fields), F.array(F.lit("unknown")))
    for k, f in fields.items():
        got = F.try_variant_get("value", "$", f.type)
        rules = [F.when(F.is_variant_null("value") | got.isNull(), "type")]
        rules += [F.when(got < f.least, "least")] if f.least is not None else []
        rules += [F.when(got > f.most, "most")] if f.most is not None else []
        rules += [F.when(~got.isin(*f.allowed), "allowed")] if f.allowed else []
        broken = broken.when(F.col("key") == k, F.array_compact(F.array(*rules)))
    found = dotted.select("scope", "key", F.explode(broken).alias("rule"))
    needed = [k for k, f in fields.items() if f.required]
    lacking = settings.groupBy("scope").agg(F.collect_set(F.array_join("key", ".")).alias("keys"))  # at most the keys of one scope
    lacking = lacking.select("scope", F.explode(F.array_except(F.array(*map(F.lit, needed)).cast("array<string>"), "keys")).alias("key"), F.lit("missing").alias("rule"))
    return found.unionByName(lacking)
