"""Reading and writing entities as files, with the types of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..model import Entity
from ..plans.lower import TYPES


def schema_of(entity: Entity) -> T.StructType:
    """Spark types of an entity's columns; without a type a column is text."""
    fields = []
    for name, e in entity.flat().items():
        if e.calc is not None:
            continue
        base, _, size = (e.type or "String").partition("(")
        kind = TYPES.get(base.lower(), "string")
        fields.append(f"`{name}` {kind.partition('(')[0] + '(' + size if size and kind.startswith('decimal') else kind}")
    return T.StructType.fromDDL(", ".join(fields))


def read_csv(spark: SparkSession, path: str, entity: Entity, sep: str = ";") -> DataFrame:
    """Initial data: a header names columns in any order; types come from the model, so nothing is inferred."""
    names = spark.read.option("sep", sep).csv(path).first()
    wanted = {f.name: f for f in schema_of(entity)}
    fields = [wanted.get(n, T.StructField(n, T.StringType())) for n in names]
    return spark.read.schema(T.StructType(fields)).option("sep", sep).option("header", True).csv(path).select(*[f"`{n}`" for n in names if n in wanted])


def read_json(spark: SparkSession, path: str, entity: Entity, lines: bool = True) -> DataFrame:
    """JSON objects, one a line or one array a file; absent properties are null."""
    return spark.read.schema(schema_of(entity)).option("multiLine", not lines).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("overwrite").parquet(path)
