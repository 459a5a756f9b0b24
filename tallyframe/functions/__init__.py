from tallyframe.functions.hashing import hash60
from tallyframe.functions.text import (
    fixed_text,
    interval_text,
    map_flag,
    mean_std_text,
    run_prefix,
    run_seed,
    stars,
    strip_space,
)
from tallyframe.functions.vectors import (
    argmax,
    confidence,
    cross_entropy,
    focal_term,
    log_softmax,
    softmax,
    symmetric_kl_term,
)

__all__ = [
    "argmax",
    "confidence",
    "cross_entropy",
    "fixed_text",
    "focal_term",
    "hash60",
    "interval_text",
    "log_softmax",
    "map_flag",
    "mean_std_text",
    "run_prefix",
    "run_seed",
    "softmax",
    "stars",
    "strip_space",
    "symmetric_kl_term",
]
