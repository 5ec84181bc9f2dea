"""Stage timing, and latency roll-ups over ``spans(trace_id, stage, ms)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stage names, of which all but the last belong to retrieval.
RETRIEVAL_STAGES = ("query_rewrite", "search", "embed_query", "bm25_search", "dense_search", "fusion", "rerank", "assemble_context")
GENERATE = "generate"


class Clock:
    """Times the stages of a batch: a stage's rows are computed and kept, and each of the batch's traces gets an equal share."""

    def __init__(self):
        self.stages: list[tuple[str, float, int]] = []
        self.held: list[DataFrame] = []

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        import time

        began = time.perf_counter()
        rows = rows.persist()
        n = rows.count()
        self.held.append(rows)
        self.stages.append((name, 1000 * (time.perf_counter() - began), n))
        return rows

    def spans(self, traces: DataFrame) -> DataFrame:
        """``traces(trace_id)`` to (trace_id, stage, ms, meta); meta holds the rows that the stage gave."""
        n = max(1, traces.count())
        steps = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(ms / n).alias("ms"), F.create_map(F.lit("rows"), F.lit(str(rows))).alias("meta")) for s, ms, rows in self.stages])
        return traces.select("trace_id", F.inline(steps)) if self.stages else traces.select("trace_id", F.lit("").alias("stage"), F.lit(0.0).alias("ms"), F.create_map(F.lit(""), F.lit("")).alias("meta")).limit(0)

    def release(self) -> None:
        for rows in self.held:
            rows.unpersist()
        self.held.clear()


#: Buckets of a half per cent of their value, by which a percentile's place is found.
BUCKETS_PER_E = 200


def _summary(rows: DataFrame, key: str) -> DataFrame:
    """n, mean, p50, p95 of ``ms`` by key: the values at floor((n - 1) q) of the sorted ones, which were observed.

    Equal values are counted first, then the values of a bucket, so that a window over some thousand buckets finds
    the bucket and the place in it; only the distinct values of that bucket are sorted.
    """
    from pyspark.sql import Window

    bucket = F.when(F.col("ms") > 0, F.floor(F.ln("ms") * BUCKETS_PER_E)).otherwise(F.lit(-(10**9))).alias("b")
    counts = rows.groupBy(key, "ms").agg(F.count("*").alias("c")).select("*", bucket)
    cells = counts.groupBy(key, "b").agg(F.sum("c").alias("c"), F.sum(F.col("ms") * F.col("c")).alias("total"))
    whole = Window.partitionBy(key)
    placed = cells.withColumn("upto", F.sum("c").over(whole.orderBy("b"))).withColumn("n", F.sum("c").over(whole))
    ranks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.floor((F.col("n") - 1) * q).alias("at")) for q in (0.5, 0.95)])).alias("r")
    wanted = placed.select(key, "b", "upto", "c", ranks).where((F.col("upto") > F.col("r.at")) & (F.col("upto") - F.col("c") <= F.col("r.at")))
    wanted = wanted.select(key, "b", "r.q", (F.col("r.at") - F.col("upto") + F.col("c")).alias("at"))
    inside = counts.join(wanted, [key, "b"]).withColumn("run", F.sum("c").over(Window.partitionBy(key, "q").orderBy("ms")))
    value = lambda q: F.round(F.min(F.when((F.col("q") == q) & (F.col("run") > F.col("at")), F.col("ms"))), 2)
    stats = placed.groupBy(key).agg(F.max("n").alias("n"), F.round(F.sum("total") / F.max("n"), 2).alias("mean_ms"))
    return stats.join(inside.groupBy(key).agg(value(0.5).alias("p50_ms"), value(0.95).alias("p95_ms")), key)


def latency_summary(spans: DataFrame, retrieval_stages: tuple[str, ...] = RETRIEVAL_STAGES) -> DataFrame:
    """Per stage, spans summed per trace first; and TOTAL and TOTAL_RETRIEVAL over traces.

    A stage that never ran has no row.  A trace without retrieval spans counts 0 there.
    """
    per_stage = spans.groupBy("trace_id", "stage").agg(F.sum("ms").alias("ms"))
    totals = per_stage.groupBy("trace_id").agg(
        F.sum("ms").alias("TOTAL"), F.sum(F.when(F.col("stage").isin(*retrieval_stages), F.col("ms")).otherwise(0.0)).alias("TOTAL_RETRIEVAL")
    )
    long = totals.select("trace_id", F.inline(F.array(*[F.struct(F.lit(t).alias("stage"), F.col(t).alias("ms")) for t in ("TOTAL", "TOTAL_RETRIEVAL")])))
    return _summary(per_stage.unionByName(long), "stage")


def trace_totals(spans: DataFrame, retrieval_stages: tuple[str, ...] = RETRIEVAL_STAGES) -> DataFrame:
    return spans.groupBy("trace_id").agg(
        F.round(F.sum("ms"), 2).alias("total_ms"), F.round(F.sum(F.when(F.col("stage").isin(*retrieval_stages), F.col("ms")).otherwise(0.0)), 2).alias("retrieval_ms"), F.count("*").alias("n_spans")
    )


def trace_export(spans: DataFrame, order: str = "position") -> DataFrame:
    """(trace_id, total_ms, spans array) with values to two decimals."""
    return spans.groupBy("trace_id").agg(
        F.round(F.sum("ms"), 2).alias("total_ms"), F.transform(F.array_sort(F.collect_list(F.struct(order, "stage", F.round("ms", 2).alias("ms")))), lambda s: F.struct(s["stage"].alias("stage"), s["ms"].alias("ms"))).alias("spans")
    )
