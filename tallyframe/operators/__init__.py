from tallyframe.operators import (
    association,
    cells,
    errors,
    labels,
    large_heads,
    metrics,
    percentiles,
    resample,
    runs,
    scoring,
    splits,
    training,
)

__all__ = [
    "association",
    "cells",
    "errors",
    "labels",
    "large_heads",
    "metrics",
    "percentiles",
    "resample",
    "runs",
    "scoring",
    "splits",
    "training",
]
