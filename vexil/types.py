"""Enums and checks shared by the operators."""

from __future__ import annotations

from enum import Enum


class Metric(str, Enum):
    L2 = "l2"
    COSINE = "cosine"
    INNER_PRODUCT = "inner_product"


class Clustering(str, Enum):
    LLOYD = "lloyd"
    EMEANS = "emeans"


class PQDistance(str, Enum):
    ADC = "adc"
    SDC = "sdc"


class IndexType(str, Enum):
    FLAT = "flat"
    IVF = "ivf"
    HNSW = "hnsw"
    SPARSE = "sparse"
    SPARSE_APPROX = "sparse_approx"
    HYBRID = "hybrid"


def require(test: bool, message: str, kind: type[Exception] = ValueError) -> None:
    if not test:
        raise kind(message)
