"""From tables of one genome and drug a row to decisions and report documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .contracts import ContractError

#: What each report says of itself.
WARNING = "For research on existing data; a laboratory must confirm each call before anybody acts on it."
#: Least identity and coverage of a target's alignment, and its greatest e-value (fixed values); the last two for RNA, identity in percent.
MIN_IDENTITY, MIN_COVERAGE, MAX_EVALUE = 0.80, 0.60, 1e-10
MIN_RNA_IDENTITY, MIN_RNA_COVERAGE = 70.0, 0.80
#: A drug registry's table that is broadcast has so many rows at most.
REGISTRY_ROWS = 10_000


def feature_vector(detected: Column, names: list[str]) -> tuple[Column, Column]:
    """The binary vector of ordered features, and detected features that are not among them."""
    known = F.array(*map(F.lit, names))
    return F.transform(known, lambda x: F.array_contains(detected, x).cast("int")), F.array_sort(F.array_except(detected, known))


def require_registry(registry: DataFrame, drugs: list[str], key: str = "drug") -> DataFrame:
    """The registry, which must have each drug that models are there for."""
    there = {r[0] for r in registry.select(key).collect()}
    if missing := sorted(set(drugs) - there):
        raise ContractError(f"no registry entry: {', '.join(missing)}")
    return registry


def best_hits(hits: DataFrame, query: str, evalue: str, bitscore: str, where: Column) -> DataFrame:
    """The hit of least e-value, then greatest score, of each query, among those that count."""
    rest = [c for c in hits.columns if c != query]
    best = hits.where(where).groupBy(query).agg(F.min_by(F.struct(*rest), F.struct(F.col(evalue), -F.col(bitscore))).alias("h"))
    return best.select(query, "h.*")


def alignment(identities: Column, begin: Column, end: Column, reference_length: Column) -> tuple[Column, Column]:
    """Identity and reference coverage of an alignment, 0 where there is nothing to divide by.

    ``identities`` has a letter where both sequences agree, and places count from 1, ends included.
    """
    n = F.char_length(F.coalesce(identities, F.lit("")))
    alike = F.char_length(F.regexp_replace(F.coalesce(identities, F.lit("")), r"[^\p{L}]", ""))
    return F.when(n > 0, alike / n).otherwise(F.lit(0.0)), F.when(reference_length > 0, (end - begin + 1) / reference_length).otherwise(F.lit(0.0))


def target_found(identity: Column, coverage: Column, evalue: Column) -> Column:
    """Whether a protein hit shows its target."""
    return (identity >= MIN_IDENTITY) & (coverage >= MIN_COVERAGE) & (evalue <= MAX_EVALUE)


def rna_target_found(identity_percent: Column, length: Column, query_length: Column) -> Column:
    return (identity_percent >= MIN_RNA_IDENTITY) & (length / query_length >= MIN_RNA_COVERAGE)


def target_status(registry: DataFrame, hits: DataFrame, genomes: DataFrame, symbol: str = "symbol") -> DataFrame:
    """(genome_id, drug, status, detected, required_count): targets found for each of ``genomes`` and each drug.

    A genome without a hit has no target verified. ``registry`` has a row a drug and is
    broadcast as far as it has REGISTRY_ROWS rows.
    """
    small = F.broadcast if registry.count() <= REGISTRY_ROWS else (lambda x: x)
    wanted = small(registry.select("drug", "minimum_targets_detected", F.explode("target_symbols").alias("_symbol")))
    genomes = genomes.select("genome_id").distinct()
    found = hits.join(wanted, hits[symbol] == wanted._symbol).groupBy("genome_id", "drug").agg(F.array_sort(F.collect_set("_symbol")).alias("detected"))
    every = genomes.join(small(registry.select("drug", "minimum_targets_detected")), F.lit(True))  # a row for each genome and drug is the result
    out = every.join(found, ["genome_id", "drug"], "left").withColumn("detected", F.coalesce("detected", F.array().cast("array<string>")))
    status = F.when(F.size("detected") >= F.col("minimum_targets_detected"), "present").otherwise("not_verified")
    return out.select("genome_id", "drug", status.alias("status"), "detected", F.col("minimum_targets_detected").alias("required_count"))


def decide(rows: DataFrame, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Adds model_signal, call, category, reasons and confidence to rows with the gates' inputs.

    Inputs: p, the boundaries (null where there is none), qc_reasons, lineage_status,
    similarity, similarity_floor, unknown_features, relevant, strong (arrays) and target_status.
    """
    p = F.col("p")
    signal = F.when(F.col(lower).isNotNull() & (p <= F.col(lower)), "susceptible_signal").when(F.col(upper).isNotNull() & (p >= F.col(upper)), "resistant_signal").otherwise("no_call")
    rows = rows.withColumn("model_signal", signal)
    unknown, qc = F.size("unknown_features") > 0, F.size("qc_reasons") == 0
    lineage = F.col("lineage_status") == "in_distribution"
    inside = ~unknown & (F.col("similarity") >= F.col("similarity_floor"))
    made = C.decision(qc=qc, lineage=lineage, inside=inside, signal=F.col("model_signal"), relevant=F.size("relevant") > 0, strong=F.size("strong") > 0, target=F.col("target_status") == "present")
    first = made.pop("reason")
    reasons = (
        F.when(~qc, F.transform("qc_reasons", lambda r: F.concat(F.lit("qc:"), r))).when(~lineage, F.array(F.concat(F.lit("lineage_"), "lineage_status")))
        .when(~inside, F.concat(F.array(F.lit("outside_amr_feature_distribution")), F.when(unknown, F.array(F.lit("unseen_amr_features_detected"))).otherwise(F.array().cast("array<string>"))))
        .when(first == "", F.array().cast("array<string>")).otherwise(F.array(first))
    )
    out = rows.withColumns({**made, "reasons": reasons})
    return out.withColumn("confidence", C.confidence(F.col("call"), p))


def documents(decisions: DataFrame, genomes: DataFrame, key: str = "genome_id") -> DataFrame:
    """One report a genome: its own columns, the warning, and its decisions in order of drug."""
    inner = [c for c in decisions.columns if c != key]
    made = decisions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("drug", *[c for c in inner if c != "drug"]))).alias("decisions"))
    out = genomes.join(made, key, "left").withColumn("decisions", F.coalesce("decisions", F.array()))
    return out.withColumns({"schema_version": F.lit("1.0"), "warning": F.lit(WARNING), "defensive_use_only": F.lit(True), "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def cached(requests: DataFrame, reports: DataFrame, key: str = "analysis_id", digest: str = "sha256") -> DataFrame:
    """For each request the report of the same identifier and content, or null."""
    kept = reports.select(key, F.col(digest).alias("_digest"), "report")
    return requests.join(kept, key, "left").withColumn("report", F.when(F.col("_digest") == F.col(digest), F.col("report"))).drop("_digest")


def analysis_id(digest: Column) -> Column:
    return F.substring(digest, 1, 20)


def score(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Calls against labels of the same genome and drug, each of them once."""
    from .contracts import join_one_to_one
    from .metrics import report_metrics

    return report_metrics(join_one_to_one(decisions.select("genome_id", "drug", "call"), truth.select("genome_id", "drug", "y"), ["genome_id", "drug"]), ["drug"])


def decision_of(decisions: Column, drug) -> Column:
    """A report's decision on a drug, or its first one."""
    return F.coalesce(F.get(F.filter(decisions, lambda x: x["drug"] == drug), F.lit(0)), F.get(decisions, F.lit(0)))


def public(bundle: DataFrame) -> DataFrame:
    """What is told of a bundle's models: all but the features, which make long rows."""
    return bundle.drop("feature_columns", "coefficients", "platt")
