"""The index of a corpus: chunks, lexical tables, vectors, and a fingerprint that guards reuse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.operators import dense, lexical


class IndexMismatch(RuntimeError):
    """Tables of an index do not belong together."""


@dataclass(frozen=True)
class CorpusIndex:
    chunks: DataFrame
    lexical: lexical.LexicalIndex | None
    vectors: DataFrame | None
    fingerprint: str

    @classmethod
    def build(cls, chunks: DataFrame, cfg: Config, vectors: DataFrame | None = None) -> CorpusIndex:
        """``vectors(chunk_id, embedding)`` replaces the built-in embedder."""
        r = cfg.retrieval
        words = lexical.build_index(chunks, r.bm25) if r.bm25.enabled else None
        if vectors is None and r.dense.enabled:
            vectors = dense.hashing_embedder(chunks, "chunk_id", prefix=r.dense.passage_prefix, normalize=r.dense.normalize)
        return cls(chunks, words, vectors if r.dense.enabled else None, cfg.fingerprint())

    def tables(self) -> list[DataFrame]:
        words = self.lexical
        return [self.chunks, *([words.postings, words.terms, words.lengths, words.corpus] if words else []), *([self.vectors] if self.vectors is not None else [])]

    def persist(self) -> CorpusIndex:
        """Holds the tables for a run of several passes over an index that is not saved; ``unpersist`` lets them go."""
        for rows in self.tables():
            rows.persist()
        return self

    def unpersist(self) -> None:
        for rows in reversed(self.tables()):
            rows.unpersist()

    def problems(self) -> DataFrame:
        """(chunk_id, problem): repeated ids, and ids that only one of the tables has."""
        repeated = self.chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id", F.lit("repeated id").alias("problem"))
        for name, other in (("lexical", self.lexical and self.lexical.lengths), ("vectors", self.vectors)):
            if other is not None:
                for left, right, text in ((self.chunks, other, f"not in {name}"), (other, self.chunks, f"only in {name}")):
                    repeated = repeated.unionByName(left.select("chunk_id").join(right.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit(text).alias("problem")))
        return repeated

    def validate(self) -> CorpusIndex:
        if found := self.problems().limit(5).collect():
            raise IndexMismatch("; ".join(f"{r['chunk_id']}: {r['problem']}" for r in found))
        return self

    def get(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == chunk_id)

    def statistics(self) -> DataFrame:
        """One row: chunks, documents, mean / min / max tokens, terms, width of vectors."""
        base = self.chunks.agg(
            F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_documents"), F.avg("token_count").alias("mean_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens")
        )
        if self.lexical:
            base = base.join(self.lexical.terms.agg(F.count("*").alias("n_terms")))
        if self.vectors is not None:
            base = base.join(self.vectors.agg(F.max(F.size("embedding")).alias("dimension")))
        return base

    def save(self, path: str) -> None:
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        if self.lexical:
            self.lexical.save(f"{path}/lexical")
        if self.vectors is not None:
            self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        meta = [(self.fingerprint, self.lexical is not None, self.vectors is not None)]
        self.chunks.sparkSession.createDataFrame(meta, "fingerprint string, has_lexical boolean, has_vectors boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, cfg: Config | None = None, strict: bool = True) -> CorpusIndex:
        """A fingerprint that differs from the configuration's raises if ``strict``, else warns."""
        meta = spark.read.parquet(f"{path}/meta").first()
        if cfg is not None and meta["fingerprint"] != cfg.fingerprint():
            text = f"index was built with {meta['fingerprint']}, the configuration is {cfg.fingerprint()}"
            if strict:
                raise IndexMismatch(text)
            import warnings

            warnings.warn(text, stacklevel=2)
        words = lexical.LexicalIndex.load(spark, f"{path}/lexical") if meta["has_lexical"] else None
        vectors = spark.read.parquet(f"{path}/vectors") if meta["has_vectors"] else None
        return cls(spark.read.parquet(f"{path}/chunks"), words, vectors, meta["fingerprint"])
