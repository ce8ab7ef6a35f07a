"""Readers and sinks. Data goes between executors and storage, never through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class SchemaMismatch(ValueError):
    pass


def expect_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Check names (case-insensitively) and types, then project to the declared columns."""
    have = {f.name.lower(): f.dataType for f in df.schema.fields}
    problems = []
    for field in schema.fields:
        kind = have.get(field.name.lower())
        if kind is None:
            problems.append(f"missing {field.name}")
        elif kind != field.dataType:
            problems.append(f"{field.name} is {kind.simpleString()}, not {field.dataType.simpleString()}")
    if problems:
        raise SchemaMismatch("; ".join(problems))
    return df.select(*[F.col(f.name).alias(f.name) for f in schema.fields])


def source(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A catalog table, or a Parquet directory when ``name`` is a path (always the whole directory)."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df if schema is None else expect_schema(df, schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV with a header and a declared schema; a malformed row fails the job instead of turning null."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, mode="FAILFAST")


def sink(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
         partition_by: list[str] | None = None) -> None:
    """Write Parquet, CSV with header, or JSON lines. ``errorifexists`` refuses to replace data."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


GROUPS_JSON = T.StructType([T.StructField("node", T.StringType()), T.StructField("com", T.StringType())])


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Node to prior group, one JSON record per line."""
    return spark.read.schema(GROUPS_JSON).json(path)


def write_groups(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    sink(df.select("node", "com"), path, "json", mode)


EDGES = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("layer", T.StringType()),
])


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Edge table partitioned by layer, so a one-layer graph reads one directory."""
    sink(edges.select("src", "dst", "weight", "layer"), path, "parquet", mode, ["layer"])


def read_edges(spark: SparkSession, path: str, layers: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(EDGES).parquet(path)
    return df if layers is None else df.filter(F.col("layer").isin(*layers))
