"""Lookup databases: JSON files of elements, lines, absorption coefficients and line names; text of efficiencies.

Each is small next to a cube: an entry for each element, line or energy step of a fixed range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def periodic_table(spark: SparkSession, path: str) -> DataFrame:
    """(element, number, atomic_mass, density)"""
    rows = _json(spark, path, "table map<string,struct<atomic_mass:double,density:double,number:int>>")
    return rows.select(F.explode("table").alias("element", "v")).select("element", "v.number", "v.atomic_mass", "v.density")


def periodic_table_by_number(spark: SparkSession, path: str) -> DataFrame:
    """(element, number, atomic_mass, density) of a table keyed by atomic number."""
    rows = _json(spark, path, "table map<string,struct<atomic_mass:double,density:double,symbol:string>>")
    return rows.select(F.explode("table").alias("n", "v")).select(F.col("v.symbol").alias("element"), F.col("n").cast("int").alias("number"), "v.atomic_mass", "v.density")


def xray_lines(spark: SparkSession, path: str, elements: list[str] | None = None) -> DataFrame:
    """(element, line, energy, cs); fails if one of the elements is missing."""
    rows = _json(spark, path, "table map<string,map<string,struct<energy:double,cs:double>>>")
    lines = rows.select(F.explode("table").alias("element", "m")).select("element", F.explode("m").alias("line", "v")).select("element", "line", "v.energy", "v.cs")
    return only(lines, elements)


def absorption_coefficients(spark: SparkSession, path: str, elements: list[str] | None = None) -> DataFrame:
    """(element, energy, mac); fails if one of the elements is missing."""
    energies, values = "energies (keV)", "mass_absorption_coefficient (cm2/g)"
    rows = _json(spark, path, f"interpolated_MACs map<string,struct<`{energies}`:array<double>,`{values}`:array<double>>>")
    macs = rows.select(F.explode("interpolated_MACs").alias("element", "v"))
    pairs = F.arrays_zip(F.col(f"v.`{energies}`").alias("energy"), F.col(f"v.`{values}`").alias("mac"))
    return only(macs.select("element", F.explode(pairs).alias("p")).select("element", "p.energy", "p.mac"), elements)


def line_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, aliases): names of one notation and what they may be in the other."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "aliases"))


def detector_efficiency(spark: SparkSession, path: str) -> DataFrame:
    """(energy, efficiency) from lines of two numbers."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("double").alias("energy"), parts[1].cast("double").alias("efficiency"))


def only(rows: DataFrame, elements: list[str] | None) -> DataFrame:
    """The rows of these elements; fails if one has none."""
    if elements is None:
        return rows
    found = rows.where(F.col("element").isin(elements))
    missing = set(elements) - {r["element"] for r in found.select("element").distinct().collect()}
    if missing:
        raise ValueError(f"not in the database: {', '.join(sorted(missing))}")
    return found
