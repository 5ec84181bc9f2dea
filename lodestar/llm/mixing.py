"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Documents fall into cells, the combinations of the margin columns (source, language, topic).  A cell's
weight starts as its share of tokens and is raked: for one margin after another, the cells of each
value are scaled so that they sum to the value's target share; this is repeated for a number of
sweeps.  Of all tokens the share ``keep`` is wanted, and no cell can give more than it has: a
cell that reaches its supply stays there, and the next steps rake what is missing from the other cells of the
value.  A document is then kept with probability ``keep * fitted share / token share`` of its cell, at most 1,
by comparing that with a number drawn from its id, so the kept tokens follow the targets as far
as the cells' supply allows; ``margin_report`` says how far each value of each margin is met.

**Scale.**  Documents are read once to sum cells (map-side combined: a source with a third of all
rows is one row per task) and once to be sampled; texts are never shuffled.  Cells depend on
the number of distinct values, not of documents; up to ``LOCAL_CELLS`` they are raked in one
partition, beyond that by shuffles.  Cells return to documents by a join that Spark makes a
broadcast only when the measured size of the written table allows it.

**Defined cases.**  Null margin values form a value of their own, ``(null)``.  Null and empty texts
count one token, so they can be sampled.  Targets are renormalised over the values that occur;
a value without a target keeps the share it has.  Rows with the same id, null ids among them, are drawn alike.
Columns of other names are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialize

SWEEPS = 12
SWEEPS_PER_PLAN = 4
LOCAL_CELLS = 100_000
KEEP = 0.5
SEED = "mix-1"
NULL_VALUE = "(null)"


def n_tokens(text: Column) -> Column:
    """Words, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def length_topic(tokens: Column) -> Column:
    """Stand-in where a table has no topic column: a band of document length."""
    return F.when(tokens < 50, "short").when(tokens < 300, "medium").when(tokens < 1000, "long").otherwise("book")


def draw(id_col: Column, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: DataFrame, margins: list[str], targets: dict[str, dict[str, float] | None], sweeps: int = SWEEPS, keep: float = KEEP) -> DataFrame:
    """Fits ``cells(*margins, tokens)``; adds share (of tokens), fitted (share after raking) and the margins' targets.

    ``fitted`` is at most ``share / keep``, the cell's supply.  ``targets[margin]`` maps values to weights; None asks for equal weights.
    """
    n_cells, total = cells.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    local = n_cells <= LOCAL_CELLS
    work = cells.coalesce(1) if local else cells
    work = work.withColumn("share", F.col("tokens") / F.lit(float(total or 1))).withColumn("fitted", F.col("share"))
    supply = F.col("share") / F.lit(float(keep))
    free = F.col("fitted") < supply
    for m in margins:
        own = Window.partitionBy(m)
        wanted = targets.get(m)
        if wanted is None:
            raw = F.lit(1.0)
        else:
            raw = reduce(lambda c, kv: c.when(F.col(m) == kv[0], F.lit(float(kv[1]))), wanted.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.sum("share").over(own))
        work = work.withColumn(f"raw_{m}", raw).withColumn(f"cells_{m}", F.count("*").over(own))
    # each value's raw target counts once in the sum, whatever its number of cells
    sums = work.agg(*[F.sum(F.col(f"raw_{m}") / F.col(f"cells_{m}")).alias(m) for m in margins]).first()
    work = work.withColumns({f"target_{m}": F.col(f"raw_{m}") / F.lit(float(sums[m] or 1)) for m in margins})
    names = [*cells.columns, "share", "fitted", *[f"target_{m}" for m in margins]]
    work = materialize(work.select(*names), "mix-cells")
    done = 0
    while done < sweeps:
        step = min(SWEEPS_PER_PLAN, sweeps - done)
        if local:
            work = work.coalesce(1)
        for _ in range(step):
            for m in margins:
                own, target = Window.partitionBy(m), F.col(f"target_{m}")
                now, loose = F.sum("fitted").over(own), F.coalesce(F.sum(F.when(free, F.col("fitted"))).over(own), F.lit(0.0))
                up = F.when(free, F.col("fitted") * (target - (now - loose)) / loose).otherwise(F.col("fitted"))
                scaled = F.when(now >= target, F.when(now > 0, F.col("fitted") * target / now).otherwise(0.0)).when(loose > 0, up).otherwise(F.col("fitted"))
                work = work.select(*[c for c in names if c != "fitted"], F.least(supply, scaled).alias("fitted"))
        work = materialize(work.select(*names), "mix-cells")
        done += step
    return work


def margin_report(fitted: DataFrame, margins: list[str], keep: float = KEEP) -> DataFrame:
    """(margin, value, supply, target, expected) of a ``rake`` result: shares of all tokens, wanted and expected
    shares of the kept ones.

    A value whose expected share is off its target is short of supply, or more sweeps are needed.
    """
    kept = F.sum("fitted").over(Window.partitionBy(F.lit(1)))
    parts = [
        fitted.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("share").alias("supply"), F.first(f"target_{m}").alias("target"), F.sum("fitted").alias("fitted"))
        .select("margin", "value", "supply", "target", (F.col("fitted") / kept).alias("expected"))
        for m in margins
    ]
    return reduce(DataFrame.unionByName, parts)


def mix(
    docs: DataFrame, margins: list[str], targets: dict[str, dict[str, float] | None], id_col: str = "doc_id", text_col: str = "text",
    topic: bool = True, keep: float = KEEP, sweeps: int = SWEEPS, seed: str = SEED, columns: list[str] | None = None,
) -> DataFrame:
    """Every document with its cell, n_tokens, prob and sampled; ``columns`` of ``docs`` are carried."""
    carried = columns or []
    rows = docs.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__c_{c}") for c in carried], *[F.coalesce(F.col(m).cast("string"), F.lit(NULL_VALUE)).alias(m) for m in margins if m != "topic" or not topic], n_tokens(F.col(text_col)).alias("n_tokens"))
    if topic:
        rows = rows.withColumn("topic", length_topic(F.col("n_tokens")))
    cells = materialize(rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")), "mix-sums")
    fitted = rake(cells, margins, targets, sweeps, keep).select(*margins, F.least(F.lit(1.0), F.lit(keep) * F.col("fitted") / F.col("share")).alias("prob"))
    return rows.join(fitted, margins).select(
        F.col("__id").alias(id_col), *[F.col(f"__c_{c}").alias(c) for c in carried if c not in margins], *margins, "n_tokens", "prob", (draw(F.col("__id"), seed) < F.col("prob")).alias("sampled")
    )


def oracle_sql(margins: list[str], targets: dict[str, dict[str, float] | None], keep: float = KEEP, sweeps: int = SWEEPS, seed: str = SEED) -> str:
    """The same fit in DuckDB, one CTE per margin and sweep."""
    keys = ", ".join(margins)
    parts = [
        "t AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS n_tokens FROM documents)",
        "d AS (SELECT *, CASE WHEN n_tokens < 50 THEN 'short' WHEN n_tokens < 300 THEN 'medium' WHEN n_tokens < 1000 THEN 'long' ELSE 'book' END AS topic FROM t)",
        f"c0 AS (SELECT {keys}, sum(n_tokens) / (SELECT sum(n_tokens) FROM d) AS share FROM d GROUP BY {keys})",
    ]
    for m in margins:
        wanted = targets.get(m)
        raw = "1.0" if wanted is None else "CASE " + " ".join(f"WHEN v = '{k}' THEN CAST({w} AS DOUBLE)" for k, w in wanted.items()) + " ELSE s END"
        parts.append(f"r_{m} AS (SELECT v, {raw} AS raw FROM (SELECT {m} AS v, sum(share) AS s FROM c0 GROUP BY {m}))")
        parts.append(f"g_{m} AS (SELECT v, raw / (SELECT sum(raw) FROM r_{m}) AS target FROM r_{m})")
    parts.append(f"f0 AS (SELECT {keys}, share, CAST(share AS DOUBLE) AS fitted FROM c0)")
    n = 0
    for _ in range(sweeps):
        for m in margins:
            parts.append(
                f"f{n + 1} AS MATERIALIZED (SELECT {keys}, share, least(cap, CASE WHEN now >= target THEN CASE WHEN now > 0 THEN fitted * target / now ELSE 0 END"
                f" WHEN loose > 0 AND fitted < cap THEN fitted * (target - (now - loose)) / loose ELSE fitted END) AS fitted"
                f" FROM (SELECT *, sum(fitted) OVER w AS now, coalesce(sum(CASE WHEN fitted < cap THEN fitted END) OVER w, 0) AS loose"
                f" FROM (SELECT f.*, g.target, share / {keep} AS cap FROM f{n} f JOIN g_{m} g ON g.v = f.{m}) WINDOW w AS (PARTITION BY {m})))"
            )
            n += 1
    parts.append(f"p AS (SELECT {keys}, least(1.0, {keep} * fitted / share) AS prob FROM f{n})")
    return f"""
WITH {", ".join(parts)}
SELECT doc_id, {", ".join("d." + m for m in margins)}, n_tokens, round(prob, 6) AS prob,
       CAST('0x' || substr(md5('{seed}:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < prob AS sampled
FROM d JOIN p USING ({keys})
"""
