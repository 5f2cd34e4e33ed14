"""What earlier scans left behind as rows: JSON lines, JSON arrays, tables of a catalog or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "rel_path string, sha256 string, size long, language string"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the objects of all lines by a schema (unknown keys are left out, missing ones null), and the lines (line) that
    aren't objects of that schema. Blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    fine = F.col("r._bad").isNull() & F.json_object_keys("value").isNotNull()
    return parsed.where(fine).select("r.*").drop("_bad"), parsed.where(~fine).select(F.col("value").alias("line"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of files that hold one JSON array each. A file is one task's; large results belong in JSON lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_table(spark: SparkSession, table: str, jdbc: dict[str, str] | None = None, key: str | None = None, parts: int = 1, **equals: object) -> DataFrame:
    """A table of the catalog, or over JDBC (url and further options), with columns equal to given values; null asks for null.

    The comparisons reach the scan. With a numeric key, a database is read by `parts` ranges of it, else by one task."""
    if jdbc is None:
        rows = spark.read.table(table)
    else:
        options = {"dbtable": table} | jdbc
        if key is not None and parts > 1:
            bounds = spark.read.format("jdbc").options(**options).load().agg(F.min(key), F.max(key)).first()
            if bounds[0] is not None:
                options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
        rows = spark.read.format("jdbc").options(**options).load()
    for name, value in equals.items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return rows
