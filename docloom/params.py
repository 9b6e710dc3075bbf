"""Parameters of ingestion and retrieval; ``Params.from_conf`` overrides them by ``spark.docloom.<name>``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Params:
    """The defaults that results must agree with."""

    vector_k: int = 80
    keyword_k: int = 80
    final_k: int = 8
    min_score: float = 0.55
    keyword_score: float = 0.45
    near_duplicates: bool = True
    near_duplicate_threshold: float = 0.92
    near_duplicates_per_group: int = 1
    rerank_top_n: int = 24
    rerank_weight: float = 0.15
    context_chars: int = 12_000
    max_chunk: int = 1800
    min_chunk: int = 300
    upload_bytes: int = 25 * 1024 * 1024
    embed_batch: int = 256
    vector_size: int = 1024

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Params:
        given = {}
        for f in fields(cls):
            value = spark.conf.get(f"spark.docloom.{f.name}", None)
            if value is not None:
                kind = type(getattr(cls, f.name))
                given[f.name] = value.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)
        return cls(**given)
