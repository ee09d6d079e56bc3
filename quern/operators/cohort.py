"""Cohort building: auditing, cleaning, summarising and selecting labelled observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import blank_to, stable_rank, strip
from .contracts import ContractError
from .similarity import checkpointed

LABELS = ("Resistant", "Susceptible")


@dataclass(frozen=True)
class Cleaned:
    labels: DataFrame
    conflicts: DataFrame
    excluded: DataFrame


def of_species(source: DataFrame, species: str, taxon: str, evidence: str, name="Genome Name", taxon_id="Taxon ID", kind="Evidence", exact: bool = False) -> DataFrame:
    """Rows of one species (name and a space), taxon (as text) and kind of evidence.

    An audit reads the kind without regard to case and white space around it; cleaning
    (``exact``) takes it as it is written.
    """
    same = F.col(kind) == evidence if exact else F.lower(strip(F.col(kind))) == evidence.lower()
    return source.where(F.col(name).startswith(species + " ") & (F.col(taxon_id) == taxon) & same)


def excluded_counts(rows: DataFrame, drug: str, label: str, drugs: list[str] | None) -> DataFrame:
    """Both counters are of the same rows, so they overlap; without ``drugs`` each one is supported."""
    other = F.count_if(~F.col(drug).isin(drugs)) if drugs is not None else F.lit(0).cast("long")
    return rows.agg(other.alias("unsupported_drug"), F.count_if(~F.col(label).isin(*LABELS)).alias("non_binary_or_missing_label"))


def conflict_keys(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_distinct(label).alias("labels")).where("labels > 1").select(*keys)


def clean(rows: DataFrame, keys: list[str], label: str, drugs: list[str] | None = None) -> Cleaned:
    """Distinct binary labels of supported drugs without those of conflicting keys."""
    kept = rows.where(F.col(label).isin(*LABELS))
    if drugs is not None:
        kept = kept.where(F.col(keys[-1]).isin(drugs))
    conflicts = conflict_keys(kept, keys, label)
    return Cleaned(kept.distinct().join(conflicts, keys, "left_anti"), conflicts, excluded_counts(rows, keys[-1], label, drugs))


def audit(rows: DataFrame, genome: str, drug: str, label: str, flags: dict[str, str]) -> DataFrame:
    """For each drug: rows, genomes, sums of flags; and a column for each label there is."""
    sums = [F.count_if(F.col(c)).alias(name) for name, c in flags.items()]
    base = rows.groupBy(drug).agg(F.count("*").alias("observation_rows"), F.count_distinct(genome).alias("genomes"), *sums)
    return base.join(rows.groupBy(drug).pivot(label).count().na.fill(0), drug, "left")


def audit_by(rows: DataFrame, genome: str, keys: list[str], blank: list[str]) -> DataFrame:
    """Rows and genomes by keys, of which those in ``blank`` read 'missing' where empty."""
    named = rows.withColumns({c: blank_to(F.col(c)) for c in blank})
    return named.groupBy(*keys).agg(F.count("*").alias("observation_rows"), F.count_distinct(genome).alias("genomes"))


def summarize(labels: DataFrame, genome: str, drug: str, label: str) -> DataFrame:
    """Genomes by label for each drug, their total, and the share that is resistant."""
    by = labels.groupBy(drug).pivot(label, list(LABELS)).agg(F.count_distinct(genome)).na.fill(0)
    total = F.col("Resistant") + F.col("Susceptible")
    return by.withColumn("total", total).withColumn("resistant_fraction", F.try_divide(F.col("Resistant"), F.col("total"))).orderBy(F.desc("total"), drug)


def top_k_per_group(rows: DataFrame, by: list[str], k: int, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows first by hash, in order of their key."""
    return rows.withColumn("rank_hash", stable_rank(F.col(key), seed)).orderBy("rank_hash", key).limit(n).orderBy(key)


def select_genomes(labels: DataFrame, genome: str, drug: str, label: str, floor: int, cap: int, seed: int = 42) -> DataFrame:
    """A protected floor for each drug and label, filled up by coverage, then hash, to a cap.

    A cap that can't hold all protected genomes raises ContractError. Ranking past the floors takes the first ``cap`` rows only, so it needs no global sort
    in one task: the limit is pushed into each partition.
    """
    pairs = labels.select(genome, drug, label).distinct().withColumn("hash", stable_rank(F.col(genome), seed))
    floors = top_k_per_group(pairs, [drug, label], floor, ["hash", genome]).select(genome).distinct().withColumn("kept", F.lit(1))
    floors = checkpointed(floors)
    if (needed := floors.count()) > cap:
        raise ContractError(f"the floors protect {needed} genomes, the cap is {cap}")
    cover = labels.groupBy(genome).agg(F.count_distinct(drug).alias("coverage")).withColumn("hash", stable_rank(F.col(genome), seed))
    ranked = cover.join(floors, genome, "left").orderBy(F.desc(F.coalesce("kept", F.lit(0))), F.desc("coverage"), "hash", genome).limit(cap)
    return ranked.select(genome, F.col("coverage").alias("label_count"), F.col("hash").alias("selection_rank"))


def first_per_key(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key, by aggregation instead of a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("r")).select(key, "r.*")
