"""Documents parsed once and kept as nested columns.

A document is parsed with the union of all parts that its tables read, and the
result is written. A table reads the files with the schema of its own part, so
the reader leaves the other nested columns untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from diamondlap.sources.staging import fresh_path, save


def merged(*schemas: str) -> T.StructType:
    """One schema that holds the fields of all given ones."""
    return reduce(_merge, (T.StructType.fromDDL(s) for s in schemas))


def _merge(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        both = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            both[f.name] = _merge(both[f.name], f.dataType) if f.name in both else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in both.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merge(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(_merge(a.keyType, b.keyType), _merge(a.valueType, b.valueType))
    if a != b:
        raise ValueError(f"a field is {a.simpleString()} in one part and {b.simpleString()} in another")
    return a


@dataclass(frozen=True)
class ParsedDocuments:
    """Written documents: key columns and one or more parsed columns."""

    spark: SparkSession
    path: str
    keys: T.StructType

    def rows(self, column: str | None = None, schema: T.DataType | str | None = None) -> DataFrame:
        """The key columns and, of a parsed column, only the fields of `schema`."""
        fields = list(self.keys.fields)
        if column is not None:
            fields.append(T.StructField(column, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema))
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path)


def write_parsed(rows: DataFrame, nested: Sequence[str], label: str) -> ParsedDocuments:
    """Write rows whose columns `nested` are parsed; all others are keys. Files that are read a few times and
    dropped do not earn back the dictionaries of some two hundred columns."""
    path = fresh_path(rows.sparkSession, label)
    save(rows, path, **{"parquet.enable.dictionary": "false"})
    return ParsedDocuments(rows.sparkSession, path, T.StructType([f for f in rows.schema.fields if f.name not in nested]))
