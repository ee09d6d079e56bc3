"""Readers and writers. Strings stay strings: identifiers such as 1280.10 are never inferred as numbers."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(spark: SparkSession, path, sep: str = ",", empty_is_null: bool = False) -> DataFrame:
    """A delimited file, plain or compressed, with a header; all columns are strings.

    An empty field is an empty string, as is a literal NA itself, unless ``empty_is_null``.
    """
    df = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("nullValue", "").option("multiLine", False).csv(path)
    return df if empty_is_null else df.na.fill("")


def fasta(spark: SparkSession, path) -> DataFrame:
    """(genome_id, contig_idx, header, sequence) of sequence files; the stem of a path is the identifier."""
    from ..functions.columns import path_stem

    files = spark.read.format("binaryFile").load(path).select(path_stem(F.col("path")).alias("genome_id"), F.decode("content", "UTF-8").alias("body"))
    return fasta_records(files)


def fasta_records(files: DataFrame, genome_id: str = "genome_id", body: str = "body") -> DataFrame:
    """Records of texts: each ``>`` begins one; its first line is the header."""
    parts = F.slice(F.split(body, ">"), 2, 1 << 30)
    rows = files.select(F.col(genome_id), F.posexplode(parts).alias("contig_idx", "record"))
    line = F.split("record", "\r?\n", 2)
    return rows.select(genome_id, "contig_idx", line[0].alias("header"), F.upper(F.regexp_replace(F.coalesce(F.get(line, F.lit(1)), F.lit("")), r"\s", "")).alias("sequence"))


def reports(spark: SparkSession, path, schema) -> DataFrame:
    """Report documents below a folder."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.report.json").json(path)


def blast_hits(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema("qseqid string, qlen int, length int, pident double, evalue double").option("sep", "\t").csv(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The drug registry, a small TOML file on the driver, as rows; it has the parts ``registry`` and ``drugs``."""
    with open(path, "rb") as f:
        whole = tomllib.load(f)
    if not {"registry", "drugs"} <= set(whole):
        raise ValueError("a drug registry has the parts registry and drugs")
    drugs = whole["drugs"]
    rows = [(k, v.get("target_label", ""), v.get("target_probe_kind", ""), list(v.get("target_symbols", [])), list(v.get("resistance_terms", [])), int(v.get("minimum_targets_detected", 1))) for k, v in sorted(drugs.items())]
    return spark.createDataFrame(rows, "drug string, target_label string, target_probe_kind string, target_symbols array<string>, resistance_terms array<string>, minimum_targets_detected int")


def write_csv(df: DataFrame, path: str) -> None:
    """Lists and structures are written as JSON."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    df.withColumns(nested).write.mode("overwrite").option("header", True).csv(path)


def write_both(df: DataFrame, parquet: str, csv: str) -> None:
    """Parquet, and CSV of the Parquet just written, so the plan runs once."""
    df.write.mode("overwrite").parquet(parquet)
    write_csv(df.sparkSession.read.parquet(parquet), csv)


def _in_order(c: Column, kind: DataType) -> Column:
    """A value whose structures have their fields in order of names."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_in_order(c[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _in_order(x, kind.elementType))
    return c


def write_documents(df: DataFrame, path: str) -> None:
    """Each row as one JSON line, with the keys of all levels in order."""
    whole = F.struct(*[_in_order(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)])
    df.select(F.to_json(whole).alias("value")).write.mode("overwrite").text(path)


def upload_accepted(length, name, cap: int = 25 * 1024 * 1024):
    return (length <= cap) & F.lower(name).rlike(r"\.(fasta|fna|fa)$")


def first_source(ids: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """The value from the first source that has one, for each row of ``ids``; of a source's several values the least counts."""
    out = ids
    for k, s in enumerate(sources):
        out = out.join(s.groupBy(key).agg(F.min(value).alias(f"_{k}")), key, "left")
    return out.select(*ids.columns, F.coalesce(*[F.col(f"_{k}") for k in range(len(sources))]).alias(value))
