"""Mixing sources to target weights by capped water-filling.

Every source asks for weight / (sum of weights) of the budget and is clamped at `max_epochs` times
its size; what a clamped source can't take is shared again among the others by weight, until none
is above its clamp. Sorted by clamp / weight, the clamped sources are a prefix, so one pass over
running sums over the (few) sources finds the level; no loop is needed.

A source of ratio r = target / size takes every document floor(r) times, and the fraction that is
left once more from the documents of the smallest seeded hash shares. The cut comes from word counts
by (source, one of `cells` hash cells), summed before the shuffle, so that a source of any size is
cut without sorting its documents; documents in the cell of the cut take the same fraction of
their words, so that totals meet targets to a word a document, even for a source of one document.

Defined results: null or empty texts have size 0 and take nothing; documents of a null source are
one source, ordered last; a source without words has target 0; all rows of one id draw the same
share; extra columns pass through, and one that is called like a result column gets `_in` behind its name; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, beside, hash_share, n_words, place, written

RESULTS = ["size", "source_size", "target", "repeats", "taken"]


def waterfill(sources: DataFrame, budget: Column, size: str = "source_size", weight: str = "weight", max_epochs: float = 2.0) -> DataFrame:
    """Adds target (double) to a table of sources: one row for each source."""
    by_fill = Window.orderBy("__wf_fill", "__wf_key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    keyed = sources.withColumn("__wf_fill", F.lit(max_epochs) * F.col(size) / F.col(weight)).withColumn("__wf_key", F.col("__source_rank"))
    run = keyed.withColumns({
        "__wf_before": F.coalesce(F.sum(F.lit(max_epochs) * F.col(size)).over(by_fill), F.lit(0.0)),
        "__wf_weight": F.sum(F.col(weight).cast("double")).over(everything) - F.coalesce(F.sum(F.col(weight).cast("double")).over(by_fill), F.lit(0.0)),
        "__wf_budget": budget,
    })
    # The level if this source and all after it are open; a source is open if that level is within its fill.
    level = F.greatest(F.col("__wf_budget") - F.col("__wf_before"), F.lit(0.0)) / F.col("__wf_weight")
    run = run.withColumn("__wf_level", level).withColumn("__wf_open", F.col("__wf_level") <= F.col("__wf_fill"))
    found = F.min(F.when(F.col("__wf_open"), F.struct("__wf_fill", "__wf_key", "__wf_level"))).over(everything)
    at = run.withColumn("__wf_at", found)
    target = F.least(F.lit(max_epochs) * F.col(size), F.coalesce(F.col("__wf_at.__wf_level"), F.col("__wf_fill")) * F.col(weight))
    return at.withColumn("target", target.cast("double")).drop("__wf_fill", "__wf_key", "__wf_before", "__wf_weight", "__wf_budget", "__wf_level", "__wf_open", "__wf_at")


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", cells: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = False, broadcast_rows: int = 100_000,
) -> DataFrame:
    """docs with size, source_size, target, repeats and taken (words, repeats counted).

    `weights` repeat over the sources in the order of their code points, null last; `budget_share`
    of all words is shared. `repeats` has how often the document is taken (a double). Without
    `keep_text` the text column is left out, and texts are read once: their sizes are written to the
    shared folder. The plan has a row for each source; it is broadcast up to `broadcast_rows`.
    """
    rows, given = apart(docs, __id=id_col, __text=text_col, __src=source_col)
    text = place(given, text_col)
    sized = rows.withColumns({"size": n_words("__text"), "__cell": F.floor(hash_share("__id", seed=seed) * cells).cast("int")})
    sized = sized.drop("__text", "__id") if keep_text else written(sized.drop("__text", "__id", text), "mix-sizes")

    grid = sized.groupBy("__src", "__cell").agg(F.sum("size").alias("__words"))
    totals = grid.groupBy("__src").agg(F.sum("__words").alias("source_size"))
    order = Window.orderBy(F.col("__src").asc_nulls_last())
    ranked = totals.withColumn("__source_rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__source_rank"), F.lit(len(weights))) + 1).cast("int"))
    plan = waterfill(ranked.withColumn("weight", weight), F.lit(float(budget_share)) * F.sum("source_size").over(Window.partitionBy()), max_epochs=max_epochs)

    # Where the fraction of each source ends: the words of the cells before, and the share of that cell.
    running = Window.partitionBy("__src").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells_of = grid.withColumn("__before", F.coalesce(F.sum("__words").over(running), F.lit(0)))
    whole = F.floor(F.col("target") / F.col("source_size"))
    plan = plan.withColumn("__whole", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("__need", F.col("target") - F.col("__whole") * F.col("source_size"))
    same = F.col("c.__src").eqNullSafe(F.col("p.__src"))
    cut = (
        cells_of.alias("c").join(plan.alias("p"), same)
        .filter((F.col("__before") <= F.col("__need")) & (F.col("__words") > 0))
        .groupBy("p.__src")
        .agg(F.max_by(F.struct(F.col("__cell").alias("cell"), ((F.col("__need") - F.col("__before")) / F.col("__words")).alias("part")), F.col("__cell")).alias("__cut"))
    )
    cut = cut.withColumnRenamed("__src", "__cut_src")
    plan = plan.join(cut, plan["__src"].eqNullSafe(cut["__cut_src"]), "left").drop("__cut_src")
    plan = written(plan.select(F.col("__src").alias("__plan_src"), "source_size", "target", "__whole", "__cut"), "mix-plan")
    if plan.count() <= broadcast_rows:
        plan = F.broadcast(plan)

    out = sized.join(plan, sized["__src"].eqNullSafe(plan["__plan_src"]), "left")
    extra = F.when(F.col("__cell") < F.col("__cut.cell"), F.lit(1.0)).when(F.col("__cell") == F.col("__cut.cell"), F.least(F.col("__cut.part"), F.lit(1.0))).otherwise(F.lit(0.0))
    out = out.withColumn("__extra", F.when(F.col("__whole") >= max_epochs, F.lit(0.0)).otherwise(F.coalesce(extra, F.lit(0.0))))
    out = out.withColumn("repeats", F.when(F.col("size") > 0, F.col("__whole") + F.col("__extra")).otherwise(F.lit(0.0)))
    out = out.withColumn("taken", (F.col("__whole") * F.col("size") + F.floor(F.col("__extra") * F.col("size"))).cast("long"))
    return out.select(*beside(given, RESULTS, () if keep_text else [text]), *RESULTS)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST(floor(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 4096) AS INTEGER) AS cell
  FROM documents),
g AS (SELECT source, cell, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY ALL),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM g GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + CAST(k % 3 AS INTEGER)] AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * size / weight AS fill, 1.5::DOUBLE * sum(size) OVER () AS budget FROM w),
l AS (
  SELECT *, greatest(budget - coalesce(sum(2.0::DOUBLE * size) OVER b, 0), 0) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY fill, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT (SELECT level FROM l WHERE level <= fill ORDER BY fill, k LIMIT 1) AS level),
t AS (SELECT source, size AS source_size, CAST(least(2.0::DOUBLE * size, coalesce(m.level, fill) * weight) AS DOUBLE) AS target FROM l, m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT source, cell, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
x AS (
  SELECT c.source, max_by({'cell': cell, 'part': (target - whole * source_size - before)::DOUBLE / n}, cell) AS cut
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE before <= target - whole * source_size AND n > 0 GROUP BY c.source)
SELECT doc_id, d.size, source_size, target,
  CAST(whole * d.size + floor(CASE WHEN whole >= 2 THEN 0 WHEN cell < cut.cell THEN 1 WHEN cell = cut.cell THEN least(cut.part, 1) ELSE 0 END * d.size) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM d.source
"""
