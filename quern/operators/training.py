"""One model a drug: training with its states, and the bundle of tables that models are kept in."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import calibrated, model_signal, sigmoid
from .contracts import ContractError, join_many_to_one, require_bundle, require_columns, require_complete, require_domain, schema_digest
from .metrics import auroc, average_precision, best_thresholds, called_metrics, evaluate, threshold_candidates
from .models import fit_logistic, fit_platt, margin
from .similarity import checkpointed, least_alike, novelty_floor

#: Versions of the tables that a bundle holds.
MODEL, BUNDLE = "model-1", "bundle-1"
SPLITS = ("train", "calibration", "test")


@dataclass(frozen=True)
class Settings:
    least_train: int = 10
    least_calibration: int = 10
    c: float = 1.0
    iterations: int = 1000
    novelty_quantile: float = 0.05
    worst_low: float = 0.10
    worst_high: float = 0.10
    least_calls: int = 5


@dataclass(frozen=True)
class Model:
    """What a drug's training gave. States are skipped and trained; of its calibration
    unavailable, sigmoid, sigmoid_partial_thresholds and thresholds_unavailable."""

    drug: str
    status: str
    calibration_status: str
    reason: str | None = None
    coefficients: list[float] = field(default_factory=list)
    platt: tuple[float, float] | None = None
    lower: float | None = None
    upper: float | None = None
    novelty_floor: float | None = None

    def probability(self, features: str):
        """Raw and calibrated probability, as expressions."""
        z = margin(features, self.coefficients)
        return sigmoid(z), calibrated(z, *self.platt) if self.platt else sigmoid(z)


@dataclass(frozen=True)
class Trained:
    models: list[Model]
    columns: list[str]
    summary: DataFrame
    predictions: DataFrame
    profiles: DataFrame


def modeling_table(phenotypes: DataFrame, features: DataFrame, splits: DataFrame, genome: str = "genome_id", label: str = "label") -> tuple[DataFrame, list[str]]:
    """Phenotypes with their genome's features (missing ones 0), split and target ``y``, and the
    feature columns in order. Each genome has one row of features and splits; other labels raise."""
    columns = sorted(c for c in features.columns if c != genome)
    rows = join_many_to_one(join_many_to_one(phenotypes, features, [genome]), splits, [genome])
    rows = rows.withColumn("y", F.when(F.col(label) == "Resistant", 1).when(F.col(label) == "Susceptible", 0))
    require_complete(rows, "y")
    return rows.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns}), columns


def class_counts(rows: DataFrame) -> DataFrame:
    """For each drug, rows of each split and class."""
    y = F.col("y")
    return rows.groupBy("drug").agg(*[F.count_if((F.col("split") == s) & (y == k)).alias(f"{s}_{name}") for s in SPLITS for k, name in ((0, "susceptible"), (1, "resistant"))])


def train_drug(rows: DataFrame, drug: str, counts: dict[str, int], width: int, settings: Settings) -> Model:
    """The model of one drug's ``rows`` (x, y, split); its fits are distributed."""
    of = lambda s: rows.where(F.col("split") == s)
    both = lambda s: min(counts.get(f"{s}_susceptible", 0), counts.get(f"{s}_resistant", 0))
    if both("train") < settings.least_train:
        return Model(drug, "skipped", "unavailable", f"training needs {settings.least_train} samples of each class")
    w = fit_logistic(of("train"), "x", "y", settings.c, settings.iterations)
    profiles = of("train").select(present("x").alias("profile"))
    floor = novelty_floor(least_alike(profiles, "profile", width, settings.novelty_quantile), "similarity", settings.novelty_quantile).first()["floor"]
    if both("calibration") < settings.least_calibration:
        return Model(drug, "trained", "unavailable", None, w, None, None, None, floor)
    scored = checkpointed(of("calibration").select(margin("x", w).alias("z"), "y"))
    platt = fit_platt(scored, "z", "y")
    found = best_thresholds(threshold_candidates(scored.select(F.lit(drug).alias("drug"), calibrated(F.col("z"), *platt).alias("p"), "y"), ["drug"], settings.worst_low, settings.least_calls, settings.worst_high)).first()
    some = sum(x is not None for x in (found["lower"], found["upper"]))
    return Model(drug, "trained", ("thresholds_unavailable", "sigmoid_partial_thresholds", "sigmoid")[some], None, w, platt, found["lower"], found["upper"], floor)


def present(x: str):
    """The places, from 1, of the features that are there."""
    return F.filter(F.transform(x, lambda v, i: F.when(v > 0, i + 1)), lambda v: v.isNotNull())


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """Adds raw_p, p and model_signal; there are no calls unless the model is calibrated and has a threshold."""
    raw, p = model.probability("x")
    calls = model.calibration_status.startswith("sigmoid")
    rows = rows.withColumn("raw_p", raw).withColumn("p", p)
    return rows.withColumn("model_signal", model_signal(F.col("p"), model.lower if calls else None, model.upper if calls else None))


def train_all(rows: DataFrame, columns: list[str], settings: Settings, drugs: list[str] | None = None) -> Trained:
    """Models of all drugs, one after the other, since each fit takes the whole cluster.

    ``rows`` has genome_id, drug, split, y and ``columns``; the summary has a row a drug, and
    predictions are those of test rows.
    """
    spark = rows.sparkSession
    require_columns(rows, ["genome_id", "drug", "split", "y", *columns])
    data = checkpointed(rows.select("genome_id", "drug", "split", "y", F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x")))
    require_domain(data, "y", (0, 1))
    counts = {r["drug"]: r.asDict() for r in class_counts(data).collect()}
    made = [train_drug(data.where(F.col("drug") == d), d, counts.get(d, {}), len(columns), settings) for d in (sorted(counts) if drugs is None else drugs)]
    done = [m for m in made if m.status == "trained"]
    blank = data.limit(0).withColumns({"raw_p": F.lit(0.0), "p": F.lit(0.0), "model_signal": F.lit("")})
    predictions = blank
    for m in done:
        predictions = predictions.unionByName(predict(data.where((F.col("drug") == m.drug) & (F.col("split") == "test")), m))
    predictions = checkpointed(predictions.drop("x", "split"))
    table = spark.createDataFrame([(m.drug, m.status, m.calibration_status, m.reason, len(columns), m.lower, m.upper, m.novelty_floor) for m in made], "drug string, status string, calibration_status string, reason string, feature_count int, lower double, upper double, novelty_floor double")
    for part in (class_counts(data), evaluate(predictions, ["drug"]), auroc(predictions, ["drug"]), average_precision(predictions, ["drug"]), called_metrics(predictions, ["drug"])):
        table = table.join(part, "drug", "left")
    profiles = data.where((F.col("split") == "train") & F.col("drug").isin([m.drug for m in done])).select("drug", present("x").alias("profile")).distinct()
    return Trained(made, columns, table.withColumn("no_call_rate", 1 - F.col("coverage")), predictions, profiles)


_MODELS = "schema_version string, drug string, feature_columns array<string>, digest string, calibration_status string, coefficients array<double>, platt array<double>, lower double, upper double, novelty_floor double"


def write_bundle(spark: SparkSession, trained: Trained, path: str) -> None:
    """The models as a table, their training profiles, predictions, the summary, and a manifest of one JSON line."""
    digest, done = schema_digest(trained.columns), [m for m in trained.models if m.status == "trained"]
    rows = [(MODEL, m.drug, trained.columns, digest, m.calibration_status, [float(x) for x in m.coefficients], list(m.platt) if m.platt else None, m.lower, m.upper, m.novelty_floor) for m in done]
    spark.createDataFrame(rows, _MODELS).coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
    trained.profiles.write.mode("overwrite").partitionBy("drug").parquet(f"{path}/profiles")
    trained.predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    trained.summary.write.mode("overwrite").parquet(f"{path}/summary")
    manifest = {"schema_version": BUNDLE, "drugs": [m.drug for m in done], "feature_columns": trained.columns, "digest": digest}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> dict[str, Model]:
    """The models by drug, after all checks: versions, ordered columns and their digest, drugs, and that there is one."""
    lines = [r["value"] for r in spark.read.text(f"{path}/manifest").collect()]
    manifest = json.loads(lines[0]) if len(lines) == 1 else {}
    if manifest.get("schema_version") != BUNDLE:
        raise ContractError("the bundle's version is not supported")
    columns = manifest.get("feature_columns", [])
    if not columns:
        raise ContractError("the bundle names no features")
    require_bundle(columns, manifest.get("digest", ""))
    rows: dict[str, list] = {}
    for r in spark.read.schema(_MODELS).parquet(f"{path}/models").collect():  # a row a drug
        rows.setdefault(r["drug"], []).append(r)
    out = {}
    for drug in manifest.get("drugs", []):
        if len(rows.get(drug, [])) != 1:
            raise ContractError(f"the bundle has {len(rows.get(drug, []))} models of {drug}")
        (r,) = rows[drug]
        if r["schema_version"] != MODEL:
            raise ContractError(f"the version of {drug}'s model is not supported")
        if r["feature_columns"] != columns:
            raise ContractError(f"{drug} has other features, or in another order")
        require_bundle(r["feature_columns"], r["digest"])
        out[drug] = Model(drug, "trained", r["calibration_status"], None, r["coefficients"], tuple(r["platt"]) if r["platt"] else None, r["lower"], r["upper"], r["novelty_floor"])
    if not out:
        raise ContractError("the bundle has no models")
    return out
