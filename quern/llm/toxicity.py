r"""Toxicity scores from a weighted finite-state grammar over clauses.

Lexical transducers read letters: an Aho-Corasick automaton of word beginnings and whole
words gives each insult its weight, learned as the log-odds of labelled rows, besides a
few seeds, and threats theirs. The clause transducer is the product of four small ones over the
classes of words and quotation marks: negation (which reaches four words), quotation,
verbs of saying, and targets. Walking a clause, an insult or threat gives its weight out in
the mode of the state it meets: plain, negated or reported; the state at the clause's end says
whether it had a target. A document's features are the weights that its matched clauses add
up in each mode; a logistic layer, fitted on labelled rows, turns them into a score. A word
alone counts by the clause it stands in.

Rows whose ``crc32(doc_id as text) mod 5`` is 0 are never learned from. The fit reads at
most ``TRAIN_ROWS`` labelled rows, those first by hash; counting of terms is distributed
and only the lexicon and the few features of those rows reach the driver. Labels, lang,
source and doc_id are no inputs of a score. Scoring is one narrow pass without a shuffle.

Defined results: a null text counts as empty and gets the score of no match; texts and clauses
of any length are read whole; a null identifier counts as empty text in the crc32; repeated rows
get equal scores; of several labels of one identifier the largest counts; without labelled
rows of both classes only seeds count, with fixed weights; an empty table gives no row; other
columns, whatever their names, are ignored or, by :func:`keep_clean`, passed on.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import batch, discard, documents, mapped, small_batches, stash, texts, worker_cache

#: Labelled rows that the fit reads at most, and hashes that copies among them share.
TRAIN_ROWS, SKETCH = 20_000, 4
#: A learned term occurs in so many toxic rows, and this share of its rows is toxic.
SUPPORT, PRECISION = 4, 0.9
#: Lengths of word beginnings that are tried as terms.
LENGTHS = (4, 5, 6)

# Fixed word lists of the grammar.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown")
THREATS = ("kill", "murder", "stab", "shoot", "burn", "destroy", "hurt", "beat", "töten", "umbringen", "tuer", "matar")
TARGETS = frozenset("you your yours u he she they them him her his their du dich dein ihr sie tu te toi vous ton il elle ils tú te usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't nicht kein keine nie pas jamais non ni nunca nadie".split())
SAYING_WORDS = frozenset("said says say called calls wrote writes quoted told sagt sagte schrieb dit disait écrit dijo dice escribió".split())

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_STOP = re.compile(r"[.!?;:\n]")
_QUOTES = '"“”«»„'
_SYMBOL = re.compile(rf"{_WORD.pattern}|[{_QUOTES}]")

FEATURES = 9


def terms_of(text: str) -> set[str]:
    """Whole words (ending in ``$``) and word beginnings of a text."""
    words = set(_WORD.findall(text.lower()))
    return {w[:n] for n in LENGTHS for w in words if len(w) > n} | {w + "$" for w in words if len(w) >= 3}


class Grammar:
    """The composed transducers for one lexicon: ``{term: weight}``."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, words in ((0, lexicon.items()), (1, ((w, 2.0) for w in THREATS))):
            for term, weight in words:
                bare = term.removesuffix("$")
                self.automaton.add_word(bare, (*self.automaton.get(bare, ()), (len(bare), term != bare, weight, kind)))
        self.automaton.make_automaton()

    def matches(self, low: str) -> dict[int, tuple[float, int]]:
        """Words where a term begins: place, weight, kind; of several terms the heaviest counts."""
        found: dict[int, tuple[float, int]] = {}
        for end, entries in self.automaton.iter(low):
            for n, whole, weight, kind in entries:
                at = end - n + 1
                if (at and low[at - 1].isalpha()) or (whole and low[end + 1 : end + 2].isalpha()):
                    continue
                if at not in found or found[at] < (weight, kind):
                    found[at] = (weight, kind)
        return found

    def features(self, text: str) -> list[float]:
        """Plain, negated and reported weight, clauses with a target, plain, negated and
        reported threats at a target, the heaviest match, and matches a hundred words; all 0 without a match."""
        low = text.lower()
        found = self.matches(low)
        if not found:
            return [0.0] * FEATURES
        stops, until = [m.start() for m in _STOP.finditer(low)], -1
        states, threats, aimed, heaviest, n = [0.0, 0.0, 0.0], [0, 0, 0], 0, 0.0, 0
        for at in sorted(found):
            if at < until:
                continue
            k = bisect_left(stops, at)
            until = stops[k] if k < len(stops) else len(low)
            for mode, target, weight, kind in walk(low, stops[k - 1] + 1 if k else 0, until, found):
                if kind:
                    threats[mode] += target
                    continue
                states[mode] += weight
                aimed, heaviest, n = aimed + target, max(heaviest, weight), n + 1
        return [*np.log1p(states).tolist(), float(np.log1p(aimed)), *np.log1p(threats).tolist(), heaviest, 100 * n / (low.count(" ") + 1)]


# The clause transducer is composed of four small ones, each over the classes of a clause's
# symbols. A transducer lists its states, the first one first, each as the states that
# classes lead to; classes that are not named leave it as it is.
OTHER, TARGET, NEGATION, SAYING, QUOTE = range(5)
_WORD_CLASSES = (OTHER, TARGET, NEGATION, SAYING)
#: How many words a negation reaches, from its own word on.
REACH = 4
#: States: how many words a negation still reaches; whether a quotation is open; whether a verb of saying was met; targets met (0, 1, more).
NEGATED = [{c: REACH if c == NEGATION else max(0, left - 1) for c in _WORD_CLASSES} for left in range(REACH + 1)]
QUOTED = [{QUOTE: 1}, {QUOTE: 0}]
SAID = [{SAYING: 1}, {}]
AIMED = [{TARGET: 1}, {TARGET: 2}, {}]
PLAIN_MODE, NEGATED_MODE, REPORTED_MODE = 0, 1, 2


def compose(*machines: list[dict[int, int]]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The product of transducers that read one tape: for each state and class the next state, and
    what each state is in each of them. The first state is that of all of them."""
    begin = tuple(0 for _ in machines)
    states, at, table = [begin], {begin: 0}, []
    for state in states:  # grows as states are reached
        row = []
        for symbol in range(5):
            to = tuple(m[x].get(symbol, x) for m, x in zip(machines, state, strict=True))
            if to not in at:
                at[to] = len(states)
                states.append(to)
            row.append(at[to])
        table.append(row)
    return table, states


_MOVES, _STATES = compose(NEGATED, QUOTED, SAID, AIMED)
#: The mode of a word that meets each state, and how many targets that state has met.
_MODES = [REPORTED_MODE if quoted or said else NEGATED_MODE if left else PLAIN_MODE for left, quoted, said, _ in _STATES]
_TARGETS_MET = [met for *_, met in _STATES]


def class_of(word: str) -> int:
    return NEGATION if word in NEGATIONS else SAYING if word in SAYING_WORDS else TARGET if word in TARGETS else OTHER


def walk(low: str, begin: int, end: int, found: dict[int, tuple[float, int]]) -> list[tuple[int, bool, float, int]]:
    """Runs the composed transducer over one clause, whatever its length: (mode, whether it
    has a target, weight, kind) of each match in it. A match within a word, behind an
    apostrophe, ends that word's first part. A match is no target of its own."""
    state, out, own = 0, [], []
    for m in _SYMBOL.finditer(low, begin, end):
        if m[0] in _QUOTES:
            state = _MOVES[state][QUOTE]
            continue
        a, z = m.span()
        cuts = [a, *(x for x in range(a + 1, z) if x in found), z]
        for x, y in zip(cuts, cuts[1:], strict=False):
            kind = class_of(low[x:y].rstrip("'"))
            if x in found:
                out.append((_MODES[state], *found[x]))
                own.append(kind == TARGET)
            state = _MOVES[state][kind]
    met = _TARGETS_MET[state]
    return [(mode, met > mine, weight, kind) for (mode, weight, kind), mine in zip(out, own, strict=True)]


def grammar(lexicon: dict[str, float]) -> Grammar:
    known, key = worker_cache("toxicity"), tuple(sorted(lexicon.items()))
    if known.get("key") != key:
        known["key"], known["grammar"] = key, Grammar(lexicon)
    return known["grammar"]


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="toxic", rows=TRAIN_ROWS) -> DataFrame:
    """Text and label of the labelled rows that may be learned from, ``rows`` at most.

    Identifiers are chosen by hash before texts are read; the chosen are few enough to
    broadcast by the bound. Of labels of one identifier the largest counts. Rows of one label
    whose ``SKETCH`` least-hashed runs of three words are the same are copies, or nearly so, and
    count once, so words of a much-copied text gain no weight by its copies.
    """
    may = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    may = may.groupBy(F.col(doc_id).cast("long").alias("of")).agg(F.max(F.col(label).cast("int")).alias("label"))
    some = may.orderBy(F.xxhash64("of"), "of").limit(rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(some), F.col("id") == F.col("of"))
    rows = rows.select("label", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", F.split(F.lower("text"), r"\s+"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("words", i, 3), " ")))
    family = rows.select("label", "text", F.slice(F.array_sort(F.array_distinct(grams)), 1, SKETCH).alias("family"))
    return family.groupBy("label", "family").agg(F.max("text").alias("text")).select("text", "label")


def _count(batches):
    seen = [Counter(), Counter()]
    out = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def rows():
        for many in _chunks(sorted(seen[0].keys() | seen[1].keys())):
            yield batch(out, term=many, toxic=[seen[1][x] for x in many], clean=[seen[0][x] for x in many])

    for b in batches:
        for t, label in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
            seen[label > 0].update(terms_of(t))
        if len(seen[0]) + len(seen[1]) > 500_000:
            yield from rows()
            seen[0].clear(), seen[1].clear()
    yield from rows()


def _chunks(many: list, n: int = 50_000):
    for i in range(0, len(many), n):
        yield many[i : i + n]


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Seeds and all terms that mark toxic rows, with weights; a term within another is left out.

    There are no more terms than the bounded rows have words, SUPPORT of them for each.
    """
    counts = mapped(train, _count, "term string, toxic long, clean long", "toxicity").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    marks = counts.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    best = marks.collect()
    lexicon = {f"{x}$": 3.0 for x in INSULTS}
    kept: set[str] = set()
    for term, toxic, clean in sorted(best, key=lambda r: (len(r["term"]), r["term"])):
        if any(term[:n] in kept for n in LENGTHS if n < len(term)):
            continue
        kept.add(term)
        lexicon[term] = float(np.log((toxic + 0.5) / (clean + 0.5)))
    return lexicon


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[0.05] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Constant and weights where labelled rows of both classes are missing.
FALLBACK = [-3.0, 2.5, 0.5, 0.5, 0.5, 2.0, 0.5, 0.5, 0.5, 0.1]


def train(docs: DataFrame, labels: DataFrame, **columns) -> tuple[dict[str, float], list[float]]:
    """The lexicon and the constant and weights of the logistic layer."""
    small_batches(docs.sparkSession)
    rows = stash(training_rows(docs, labels, **columns), "labelled")  # read once for words, once for features
    lexicon = learn_lexicon(rows)

    def run(batches):
        own = grammar(lexicon)
        schema = pa.schema([("x", pa.list_(pa.float64())), ("label", pa.int32())])
        for b in batches:
            yield batch(schema, x=[own.features(t) for t in texts(b.column(0))], label=b.column(1).cast(pa.int32()))

    found = mapped(rows, run, "x array<double>, label int", "toxicity").collect()
    discard(rows)
    y = np.array([r["label"] > 0 for r in found], float)
    if not len(y) or y.min() == y.max():
        return lexicon, FALLBACK
    # rows come in any order, sums of floats don't: sort them
    x = np.array([r["x"] for r in found])
    order = np.lexsort((*x.T, y))
    return lexicon, _fit(x[order], y[order]).tolist()


def _chance(own: Grammar, w: np.ndarray, some: list[str]) -> np.ndarray:
    x = np.array([own.features(t) for t in some]).reshape(-1, FEATURES)
    return np.round(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))), 9)


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]], doc_id="doc_id", text="text") -> DataFrame:
    """One row for each row: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    lexicon, weights = model

    def run(batches):
        own = grammar(lexicon)
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
        w = np.array(weights)
        for b in batches:
            yield batch(schema, doc_id=b.column(0), held_out=b.column(1), score=_chance(own, w, texts(b.column(2))))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id).cast("long")).alias("held_out"), F.col(text).alias("text"))
    return mapped(rows, run, "doc_id long, held_out boolean, score double", "toxicity").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: tuple[dict[str, float], list[float]], text="text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns."""
    small_batches(docs.sparkSession)
    lexicon, weights = model

    def run(batches):
        own, w = grammar(lexicon), np.array(weights)
        for b in batches:
            yield b.filter(pa.array(_chance(own, w, texts(b.column(text))) < 0.5))

    return mapped(docs, run, docs.schema, "toxicity")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
