"""Column functions of the decision engine; all of them stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of ten equal bins as floating-point sums give them: 0.1 * k.
EDGES = [k * 0.1 for k in range(11)]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to(c: Column, word: str = "missing") -> Column:
    """An empty string becomes ``word``; white space alone does not."""
    return F.when(c == "", F.lit(word)).otherwise(c)


def value_map(c: Column, mapping: dict) -> Column:
    """The mapped value, null where there is none."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out


def stable_rank(c: Column, seed: int = 42) -> Column:
    """A pseudo-random order of values that depends on the seed and the value alone."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)


def id_is_well_formed(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\.[0-9]+\z")


def metadata(c: Column, key: str, default: str = "") -> Column:
    """A value of a map, or the default where there is none."""
    return F.coalesce(F.try_element_at(c, F.lit(key)), F.lit(default))


def first_upper(c: Column) -> Column:
    """With its first letter in upper case and the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def rounded(c: Column, digits: int = 4) -> Column:
    """Half to even on the value's decimal form, as reports show it."""
    return F.bround(c, digits)


def on_scale(c: Column, low: float, high: float, begin: float, end: float) -> Column:
    """A value's place on an axis from ``begin`` to ``end``, that shows ``low`` to ``high``."""
    return F.lit(begin) + (c - low) * ((end - begin) / (high - low))

def mutation_key(symbol: Column, separator: str = "_") -> Column:
    """``mutation::<part before the first separator>::<rest or 'unknown'>``."""
    head = F.substring_index(symbol, separator, 1)
    rest = F.when(F.instr(symbol, separator) > 0, F.substr(symbol, F.length(head) + 1 + len(separator))).otherwise(F.lit("unknown"))
    return F.concat(F.lit("mutation::"), head, F.lit("::"), rest)


def tokens(c: Column, separator: str = "/") -> Column:
    return F.transform(F.split(c, separator), lambda x: F.upper(F.trim(x)))


def shares_token(c: Column, terms: Sequence[str], separator: str = "/") -> Column:
    return F.arrays_overlap(tokens(c, separator), F.array(*[F.lit(t.upper()) for t in terms]))


def strong_evidence(is_point: Column, coverage: Column, identity: Column, least: float = 90.0, least_identity: float | None = None) -> Column:
    """A point mutation, or coverage and identity high enough; null counts as 0."""
    zero = F.lit(0.0)
    return is_point | ((F.coalesce(coverage.cast("double"), zero) >= least) & (F.coalesce(identity.cast("double"), zero) >= (least if least_identity is None else least_identity)))


def model_signal(p: Column, lower: float | None, upper: float | None) -> Column:
    """The lower boundary is tried first; both are inclusive."""
    out = F.when(F.lit(False), F.lit(""))
    if lower is not None:
        out = out.when(p <= lower, F.lit("susceptible_signal"))
    if upper is not None:
        out = out.when(p >= upper, F.lit("resistant_signal"))
    return out.otherwise(F.lit("no_call"))


def probability_bin(p: Column, edges: Sequence[float] = EDGES) -> Column:
    """Zero-based bin, closed on the right, the first one on both sides; null outside."""
    inner = sum(((p > F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when((p >= edges[0]) & (p <= edges[-1]), inner)


def ani(jaccard: Column, k: int) -> Column:
    """Average nucleotide identity from a k-mer Jaccard similarity; 0 without overlap."""
    return F.when(jaccard > 0, F.pow(2 * jaccard / (1 + jaccard), F.lit(1.0 / k))).otherwise(F.lit(0.0))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def calibrated(decision: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * decision + F.lit(b))


def binary_jaccard(a: Column, b: Column) -> Column:
    """Of two feature sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


def decision(*, qc: Column, lineage: Column, inside: Column, signal: Column, relevant: Column, strong: Column, target: Column) -> dict[str, Column]:
    """The gates in order, first match wins: call, category and reason.

    Quality, lineage and novelty stop a call; evidence against a susceptible signal and an
    unverified target stop that one; a resistant signal stands with or without known evidence.
    """
    susceptible, resistant = signal == "susceptible_signal", signal == "resistant_signal"
    none = "no_known_resistance_signal"
    rows = [
        (~qc, "no_call", none, "qc"),
        (~lineage, "no_call", none, "lineage_out_of_distribution"),
        (~inside, "no_call", none, "outside_amr_feature_distribution"),
        (susceptible & relevant, "no_call", "conflicting_known_resistance_evidence", "model_susceptible_but_resistance_evidence_detected"),
        (susceptible & ~target, "no_call", none, "molecular_target_not_verified"),
        (susceptible, "likely_to_work", none, ""),
        (resistant & strong, "likely_to_fail", "known_resistance_gene_or_mutation", ""),
        (resistant, "likely_to_fail", "statistical_association_only", ""),
        (relevant, "no_call", "known_resistance_evidence_but_model_uncertain", "calibrated_probability_inside_no_call_region"),
    ]
    out = {}
    for i, name in ((1, "call"), (2, "category"), (3, "reason")):
        c = F.when(rows[0][0], F.lit(rows[0][i]))
        for row in rows[1:]:
            c = c.when(row[0], F.lit(row[i]))
        out[name] = c.otherwise(F.lit(("no_call", none, "calibrated_probability_inside_no_call_region")[i - 1]))
    return out


def confidence(call: Column, p: Column) -> Column:
    return F.when(call == "likely_to_work", 1 - p).when(call == "likely_to_fail", p).otherwise(F.greatest(p, 1 - p))


def safe_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def without_sequence_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.(fasta|fna|fa)$", "")


def path_stem(c: Column) -> Column:
    """The last part of a path before its last dot, without query and fragment."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/]*)/*$", 1), r"\.[^.]*$", "")
