"""Sequence metrics, the quality gate and k-mer sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contig_metrics(contigs: DataFrame, genome: str, sequence: str, unambiguous: str = "ACGT") -> DataFrame:
    """Total length, contigs, N50 and ambiguous characters of each genome.

    N50 is the length of the contig at which the running sum, longest first, reaches half.
    """
    rows = contigs.select(genome, F.length(sequence).cast("long").alias("n"), (F.length(F.regexp_replace(sequence, f"[{unambiguous}]", ""))).cast("long").alias("odd"))
    order = Window.partitionBy(genome).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("sum_to", F.sum("n").over(order)).withColumn("whole", F.sum("n").over(Window.partitionBy(genome)))
    return run.groupBy(genome).agg(
        F.max("whole").alias("genome_length"), F.count("*").alias("contigs"),
        F.max(F.when(2 * F.col("sum_to") >= F.col("whole"), F.col("n"))).alias("contig_n50"), F.sum("odd").alias("ambiguous_bases"),
    ).withColumn("ambiguous_fraction", F.try_divide("ambiguous_bases", "genome_length"))


def fasta_error(body: Column) -> Column:
    """What is wrong with a sequence file, or null."""
    parts = F.split(body, ">")
    first, records = F.trim(F.get(parts, F.lit(0))), F.slice(parts, 2, 1 << 30)
    letters = lambda r: F.regexp_replace(F.regexp_replace(r, r"^[^\n]*\n?", ""), r"\s", "")
    return (
        F.when(F.trim(body) == "", "empty file").when(first != "", "text before the first header").when(F.size(records) == 0, "no records")
        .when(F.exists(records, lambda r: letters(r) == ""), "empty sequence").when(F.exists(records, lambda r: letters(r).rlike("(?i)[^ACGTRYSWKMBDHVN]")), "invalid character")
    )


def quality_rules(bounds: dict) -> list[tuple[Column, str]]:
    """Rules over metric columns, in the order in which their names are reported (names are fixed values).

    Rules on a source's own statements (``expected_length``, ``expected_contigs``,
    ``completeness``, ``contamination``, ``quality``) are there if ``bounds`` names their limit
    or, for the first two, is told to compare; a statement that is absent breaks no rule, save
    that ``allowed_quality``, if it is not empty, must hold the quality.
    """
    c = F.col
    stated = lambda x, wrong: c(x).isNotNull() & wrong
    more = []
    if bounds.get("compare"):
        more += [(stated(x, (c(x).cast("long") != 0) & (c(x).cast("long") != c(y))), name) for x, y, name in (("expected_length", "genome_length", "download_length_mismatch"), ("expected_contigs", "contigs", "download_contig_count_mismatch"))]
    if "minimum_completeness" in bounds:
        more.append((stated("completeness", c("completeness").cast("double") < bounds["minimum_completeness"]), "checkm_completeness_too_low"))
    if "maximum_contamination" in bounds:
        more.append((stated("contamination", c("contamination").cast("double") > bounds["maximum_contamination"]), "checkm_contamination_too_high"))
    if bounds.get("allowed_quality"):
        more.append((~F.coalesce(c("quality").isin(*bounds["allowed_quality"]), F.lit(False)), "unsupported_genome_quality"))
    return [
        (c("genome_length") < bounds["minimum_length"], "genome_too_short"), (c("genome_length") > bounds["maximum_length"], "genome_too_long"),
        (c("contigs") > bounds["maximum_contigs"], "too_many_contigs"), (c("contig_n50") < bounds["minimum_n50"], "n50_too_low"),
        (c("ambiguous_bases") / c("genome_length") > bounds["maximum_ambiguous_fraction"], "too_many_ambiguous_bases"),
        *more,
    ]


def kmer_sketch(rows: DataFrame, genome: str, sequence: str, k: int, keep: str = "0", digits: int = 1) -> DataFrame:
    """Distinct k-mers of each genome whose SHA-256 begins with ``keep``: a scaled sketch of any text.

    One pass over a text cuts its k-mers (a substring would look for its place from the text's start).
    """
    grams = F.regexp_extract_all(sequence, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    kept = F.filter(grams, lambda x: F.substring(F.sha2(x, 256), 1, digits) == keep)
    return rows.select(genome, F.explode(F.array_distinct(kept)).alias("kmer"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def dna_sketch(contigs: DataFrame, genome: str, sequence: str, k: int, scaled: int = 1) -> DataFrame:
    """(genome, kmer): distinct canonical k-mers, one of ``scaled`` by hash; k-mers with other letters than ACGT are left out.

    The hash's share that stays is fixed, so sketches of any two genomes compare.
    """
    n = F.length(sequence)
    letters = F.upper(F.col(sequence))
    grams = F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(letters, i, F.lit(k))))
    rows = contigs.select(genome, F.explode(F.array_distinct(F.filter(grams, lambda x: x.rlike("^[ACGT]+$")))).alias("kmer"))
    return rows.select(genome, canonical(F.col("kmer")).alias("kmer")).where(F.pmod(F.xxhash64("kmer"), F.lit(scaled)) == 0).distinct()


def with_digest(files: DataFrame, body: str = "body") -> DataFrame:
    """Adds the SHA-256 of a file's bytes."""
    return files.withColumn("sha256", F.sha2(F.col(body).cast("binary"), 256))
