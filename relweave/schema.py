"""Logical column types and the declaration of a relational dataset.

A column's logical type is its two-character name prefix (``n_`` numeric, ``c_`` category,
``m_`` multi-category, ``t_`` time) unless the field metadata states one, which survives
renames. Derived columns are named ``<prefix>_<table>__<statistic>__<column>``, without dots
or brackets, so that MLlib and SQL take them unquoted.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Logical type names, their name prefixes, and the multi-category delimiter.
NUM, CAT, MULTI, TIME = "num", "cat", "multi-cat", "time"
PREFIXES = {NUM: "n_", CAT: "c_", MULTI: "m_", TIME: "t_"}
DELIMITER = ","
MAIN = "main"
LABEL = "label"
ROW_ID = "row_id"

SPARK_TYPES: dict[str, T.DataType] = {
    NUM: T.DoubleType(),
    CAT: T.StringType(),
    MULTI: T.ArrayType(T.StringType()),
    TIME: T.TimestampType(),
}


def logical_type(f: T.StructField) -> str | None:
    """Logical type of a field: metadata first, then the name prefix."""
    declared = (f.metadata or {}).get("ltype")
    if declared:
        return declared
    for name, prefix in PREFIXES.items():
        if f.name.startswith(prefix):
            return name
    return None


def columns_of(df: DataFrame, *ltypes: str) -> list[str]:
    """Names of the columns that have one of the given logical types, in schema order."""
    return [f.name for f in df.schema.fields if logical_type(f) in ltypes]


def typed(column: Column, name: str, ltype: str) -> Column:
    """Alias a column and record its logical type in the field metadata."""
    return column.alias(name, metadata={"ltype": ltype})


def joined_name(table: str, column: str) -> str:
    """Name of a column of ``table`` after it was joined into another table."""
    return f"{column.split('_', 1)[0]}_{table}__{column}"


def aggregate_name(statistic: str, column: str) -> str:
    """Name of an aggregate; always numeric."""
    return f"n_{statistic}__{column}"


def keep_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Project to the wanted columns; names the frame does not have are ignored."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN and NULL are one concept here: turn NaN into NULL in floating columns."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            out.append(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name, metadata=f.metadata or {}))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


@dataclass(frozen=True)
class Relation:
    """One edge of the relation graph; ``kind`` is e.g. ``many_to_one``."""

    table_a: str
    table_b: str
    key: str
    kind: str

    @property
    def reverse_kind(self) -> str:
        return "_".join(reversed(self.kind.split("_")))


@dataclass(frozen=True)
class DatasetConfig:
    """The declaration of a dataset: table columns, relations, shared time column."""

    tables: dict[str, dict[str, str]]
    relations: tuple[Relation, ...]
    time_col: str
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> DatasetConfig:
        raw = json.loads(text)
        relations = []
        for r in raw.get("relations", []):
            key = r["key"]
            if isinstance(key, list):
                if len(key) != 1:
                    raise ValueError(f"a relation joins on one column, got {key}")
                key = key[0]
            relations.append(Relation(r["table_A"], r["table_B"], key, r["type"]))
        known = {"tables", "relations", "time_col"}
        return cls(raw["tables"], tuple(relations), raw["time_col"], {k: v for k, v in raw.items() if k not in known})

    def to_json(self) -> str:
        relations = [
            {"table_A": r.table_a, "table_B": r.table_b, "key": [r.key], "type": r.kind} for r in self.relations
        ]
        return json.dumps({"tables": self.tables, "relations": relations, "time_col": self.time_col, **self.extra})


@dataclass
class RelationalDataset:
    """The tables of one dataset (``main`` plus side tables) and their declaration."""

    tables: dict[str, DataFrame]
    config: DatasetConfig

    @property
    def main(self) -> DataFrame:
        return self.tables[MAIN]

    def with_table(self, name: str, df: DataFrame) -> RelationalDataset:
        return RelationalDataset({**self.tables, name: df}, self.config)
