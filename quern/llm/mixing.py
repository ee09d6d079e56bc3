r"""Mixing sources to target weights by capped water-filling.

A document's size is its number of words ``[^\x20\x09-\x0D]+``. Sources share ``ratio``
times all sizes by weight. A source whose share passes ``max_epochs`` times its size is
clamped there and the excess goes to the others by weight, in rounds, until none is above.

A source's target then is some whole repetitions and a fractional one. Documents take the
whole repetitions each. For the fractional one they fall by a seeded hash into
``CELLS`` cells; cells are taken whole in order up to the one in which the target is
reached, whose documents take a fractional repetition each: their first words, as many
as the rest of the target is of the cell, rounded by a second hash. So a source's words
come within rounding of its target whatever its size, no window runs over documents, and
reruns agree.

Scale: documents are read once for sizes; cells are pre-aggregated before the shuffle, so a
source with a third of all rows makes CELLS rows a task at most. What the driver holds is
three sums a round. The table of sources is broadcast only if it is counted to be small.

Defined results: a null text counts as empty; a text of any length is counted whole; a null
source is a source of its own, ordered last; a null identifier hashes as an empty one; repeated
rows, and rows of one identifier, count as often as they occur and are taken alike; without words
targets are 0; an empty table gives no row; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import discard, documents, fresh, stash

WEIGHTS = (3, 1, 2)
RATIO = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Cells that a source's documents fall into by hash.
CELLS = 4096
#: The table of sources is broadcast up to so many rows and bytes of names.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4 << 20

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(doc_id: Column, seed: int, half: int) -> Column:
    """32 bits of MD5, which SQL engines share."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1 + 8 * half, 8), 16, 10).cast("long")


def _cell(doc_id: Column, seed: int) -> Column:
    return F.shiftright(_hash32(doc_id, seed, 0), 20).cast("int")


def _unit(doc_id: Column, seed: int) -> Column:
    return _hash32(doc_id, seed, 1) / F.lit(float(2**32))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, the row number by source (code points, null last).

    Sorted by range and numbered range by range: the driver sees one count a partition.
    """
    parts = stash(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before, start = 0, []
    for row in sorted(parts.groupBy("part").count().collect()):
        start.append((row["part"], before))
        before += row["count"]
    if not start:
        return parts.withColumn("place", F.lit(0).cast("long")).drop("part")
    starts = sources.sparkSession.createDataFrame(start, "part int, start long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + inside - 1).drop("part", "start")


def water_fill(sources: DataFrame, ratio: float, max_epochs: int) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``."""
    cap = F.col("source_size") * F.lit(max_epochs)
    share = F.col("weight").cast("double")
    all_words, all_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    want = ratio * (all_words or 0)
    level, clamped = (want / all_weight if all_weight else 0.0), -1
    while True:
        over = cap <= share * F.lit(level)
        n, full, rest = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not rest:
            break
        clamped, level = n, (want - (full or 0)) / rest
    return sources.withColumn("target", F.least(cap.cast("double"), share * F.lit(level)))


def plan(sized: DataFrame, weights=WEIGHTS, ratio=RATIO, max_epochs=MAX_EPOCHS) -> tuple[DataFrame, bool]:
    """One row for each source: its target and where its fractional repetition ends.

    ``sized`` has source, size and cell. The second result says whether the table was
    counted to be small enough to broadcast.
    """
    cells = stash(sized.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells")
    of = ranked(cells.groupBy("source").agg(F.sum("words").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighted = stash(of.withColumn("weight", weight), "weights")
    of = water_fill(weighted, ratio, max_epochs)
    of = of.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    of = of.withColumn("part_words", F.col("target") - F.col("whole") * F.col("source_size"))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    run = cells.withColumn("after", up_to).withColumnRenamed("source", "cell_source")
    edge = (
        run.join(of.select("source", "part_words"), F.col("cell_source").eqNullSafe(F.col("source")))
        .where(F.col("after") > F.col("part_words"))
        .groupBy("cell_source", "part_words")
        .agg(F.min(F.struct("cell", "after", "words")).alias("e"))
        .select("cell_source", F.col("e.cell").alias("edge"), ((F.col("part_words") - (F.col("e.after") - F.col("e.words"))) / F.col("e.words")).alias("edge_share"))
    )
    done = of.join(edge, of.source.eqNullSafe(F.col("cell_source")), "left").select(of.source.alias("of_source"), "source_size", "weight", "target", "whole", F.coalesce("edge", F.lit(CELLS)).alias("edge"), F.coalesce("edge_share", F.lit(0.0)).alias("edge_share"))
    done = stash(done, "plan")
    discard(cells, weighted)
    n, names = done.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("of_source"), F.lit(0)))).first()
    return done, n <= BROADCAST_ROWS and (names or 0) <= BROADCAST_BYTES


def _joined(rows: DataFrame, of: DataFrame, small: bool, source: str) -> DataFrame:
    return rows.join(F.broadcast(of) if small else of, rows[source].eqNullSafe(of.of_source))


def _part(size: Column, doc_id: Column, seed: int) -> Column:
    """Words of the fractional repetition that a document of the edge cell takes."""
    return F.least(size, F.floor(size * F.col("edge_share") + _unit(doc_id, seed)).cast("long"))


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, ratio=RATIO, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """One row for each row: doc_id, source, size, source_size, target, taken."""
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _cell(F.col(doc_id).cast("long"), seed).alias("cell"))
    sized = stash(sized, "sizes")
    of, small = plan(sized, weights, ratio, max_epochs)
    extra = F.when(F.col("cell") < F.col("edge"), F.col("size")).when(F.col("cell") == F.col("edge"), _part(F.col("size"), F.col("doc_id"), seed)).otherwise(F.lit(0))
    return _joined(sized, of, small, "source").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("whole") + extra).cast("long").alias("taken"))


def sample(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, ratio=RATIO, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """The mix itself: ``docs``' columns, a row for each repetition.

    A fractional repetition holds the document's first words with the white space before
    them; ``n_chars``, where there is one, is counted anew for it.
    """
    key = F.col(doc_id).cast("long")
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _cell(key, seed).alias("cell"))
    of, small = plan(sized, weights, ratio, max_epochs)
    names = dict(zip(of.columns, fresh(docs, *[f"mix_{x}" for x in of.columns]), strict=True))
    cell, part, take = fresh(docs, "mix_cell", "mix_part", "mix_take")
    of = of.withColumnsRenamed(names)
    col = {k: F.col(v) for k, v in names.items()}
    rows = docs.withColumn(cell, _cell(key, seed))
    rows = rows.join(F.broadcast(of) if small else of, F.col(source).eqNullSafe(col["of_source"]))
    size = word_count(F.col(text))
    some = F.least(size, F.floor(size * col["edge_share"] + _unit(key, seed)).cast("long"))
    full = col["whole"] + F.when(F.col(cell) < col["edge"], 1).otherwise(0)
    rows = rows.withColumn(part, F.when(F.col(cell) == col["edge"], some).otherwise(F.lit(0).cast("long")))
    takes = F.concat(F.array_repeat(F.lit(-1).cast("long"), full.cast("int")), F.when(F.col(part) > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn(take, F.explode(takes))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.greatest(F.col(take), F.lit(1)).cast("int")), "")
    whole = F.col(take) < 0
    out = {text: F.when(whole, F.col(text)).otherwise(first)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.char_length(first)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE = rf"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT doc_id, source, size, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) // 1048576 AS cell,
         CAST(('0x' || substr(h, 9, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM p),
q AS (SELECT *, 2 * source_size AS cap, 2.0::DOUBLE * source_size / w AS bend,
         CAST(sum(2 * source_size) OVER o AS DOUBLE) - 2 * source_size AS full_before,
         CAST((SELECT sum(w) FROM r) - sum(w) OVER o + w AS DOUBLE) AS rest
      FROM r WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT coalesce(min_by(((SELECT 1.5::DOUBLE * sum(source_size) FROM p) - full_before) / rest, bend), 0) AS level FROM q
      WHERE ((SELECT 1.5::DOUBLE * sum(source_size) FROM p) - full_before) / rest < bend),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT level FROM l)) AS target FROM q),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
f AS (SELECT *, target - whole * source_size AS part_words FROM k),
m AS (SELECT source, cell, sum(words) OVER (PARTITION BY source ORDER BY cell) AS after, words
      FROM (SELECT source, cell, CAST(sum(size) AS BIGINT) AS words FROM c GROUP BY source, cell)),
e AS (SELECT m.source, min(m.cell) AS edge FROM m JOIN f ON m.source IS NOT DISTINCT FROM f.source WHERE m.after > f.part_words GROUP BY m.source),
g AS (SELECT f.*, coalesce(e.edge, {CELLS}) AS edge, coalesce((f.part_words - (m.after - m.words)) / m.words, 0) AS share
      FROM f LEFT JOIN e ON e.source IS NOT DISTINCT FROM f.source
      LEFT JOIN m ON m.source IS NOT DISTINCT FROM e.source AND m.cell = e.edge AND e.edge IS NOT NULL)
SELECT c.doc_id, c.source, c.size, g.source_size, g.target,
       CAST(c.size * g.whole + CASE WHEN c.cell < g.edge THEN c.size
            WHEN c.cell = g.edge THEN least(c.size, CAST(floor(c.size * g.share + c.u) AS BIGINT)) ELSE 0 END AS BIGINT) AS taken
FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
"""
