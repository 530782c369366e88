"""Coherence of embeddings: similarity of neighbours and of all others, and its rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.plans.profiles import SEMANTIC_JUMP_MIN, SEMANTIC_RANGE, SEMANTIC_REPETITION_MAX

#: Vectors compared at a time, so that memory does not grow with the square of a document.
BLOCK = 2048


def metrics(vectors: DataFrame, doc_id: str = "doc_id", order: str = "sent_no", embedding: str = "embedding") -> DataFrame:
    """``doc_id, n, adjacent_range, adjacent_min, other_max``; null under three vectors.

    Vectors are normalised; a zero vector stays zero. Each document is one block-wise matrix product.
    """

    def of_document(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        n = len(pdf)
        row = {"doc_id": pdf["d"].iloc[0], "n": n, "adjacent_range": None, "adjacent_min": None, "other_max": None}
        if n >= 3:
            size = max(map(len, pdf["e"]))
            u = np.zeros((n, size))
            for i, e in enumerate(pdf["e"]):
                u[i, : len(e)] = e
            norm = np.sqrt((u * u).sum(1, keepdims=True))
            u = np.divide(u, norm, out=np.zeros_like(u), where=norm > 0)
            near = (u[1:] * u[:-1]).sum(1)
            far = -np.inf
            for a in range(0, n, BLOCK):
                for b in range(a, n, BLOCK):
                    s = u[a : a + BLOCK] @ u[b : b + BLOCK].T
                    i, j = np.indices(s.shape, sparse=True)
                    ok = (j + b) - (i + a) >= 2
                    if ok.any():
                        far = max(far, s[ok].max())
            row |= {"adjacent_range": near.max() - near.min(), "adjacent_min": near.min(), "other_max": far}
        return pd.DataFrame([row])

    kind = vectors.schema[doc_id].dataType.simpleString()
    rows = vectors.select(F.col(doc_id).alias("d"), F.col(order).alias("o"), F.col(embedding).cast("array<double>").alias("e"))
    return rows.groupBy("d").applyInPandas(of_document, f"doc_id {kind}, n bigint, adjacent_range double, adjacent_min double, other_max double")


def findings(m: DataFrame, genre: str | None = None, least: int = 10) -> DataFrame:
    """Rules over the metrics of documents with ``least`` vectors, all inclusive."""
    rules = F.array(
        F.when(F.col("adjacent_range") <= SEMANTIC_RANGE[genre], F.struct(F.lit("semantic_flatness").alias("category"), F.lit("warn").alias("severity"), F.col("adjacent_range").alias("value"))),
        F.when(F.col("other_max") <= SEMANTIC_REPETITION_MAX, F.struct(F.lit("semantic_repetition_max").alias("category"), F.lit("info").alias("severity"), F.col("other_max").alias("value"))),
        F.when(F.col("adjacent_min") >= SEMANTIC_JUMP_MIN, F.struct(F.lit("semantic_jump_min").alias("category"), F.lit("info").alias("severity"), F.col("adjacent_min").alias("value"))),
    )
    rows = m.where(F.col("n") >= least).select("doc_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return rows.select("doc_id", "r.category", "r.severity", "r.value")
