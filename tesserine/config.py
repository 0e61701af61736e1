"""Settings of retrieval, chunking and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
RRF_WEIGHTS = {"dense": 1.0, "sparse": 1.0, "metadata": 0.8}
CANDIDATES = {"dense": 30, "sparse": 30, "metadata": 20}
WINDOW_WORDS, WINDOW_OVERLAP = 260, 40
VERY_LONG_WORDS = 340
FINAL_K = 3
NO_RANK = 1_000_000_000


@dataclass(frozen=True)
class RetrievalConfig:
    k1: float = BM25_K1
    b: float = BM25_B
    rrf_k: int = RRF_K
    dense_weight: float = RRF_WEIGHTS["dense"]
    sparse_weight: float = RRF_WEIGHTS["sparse"]
    metadata_weight: float = RRF_WEIGHTS["metadata"]
    dense_k: int = CANDIDATES["dense"]
    sparse_k: int = CANDIDATES["sparse"]
    metadata_k: int = CANDIDATES["metadata"]

    def __post_init__(self):
        if not (self.k1 > 0 and 0 <= self.b <= 1 and self.rrf_k > 0):
            raise ValueError("k1 and rrf_k must be positive and b between 0 and 1")
        if min(self.dense_weight, self.sparse_weight, self.metadata_weight) < 0:
            raise ValueError("weights must not be negative")
