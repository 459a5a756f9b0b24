"""Raw labelled text to encoded, split tables on storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.labels import (
    drop_incomplete,
    encode_wide,
    fit_encoder,
    imbalance_report,
    map_labels,
    normalise_labels,
    unpivot_labels,
)
from tallyframe.operators.splits import split_info, stratified_split
from tallyframe.sources import write_encoder, write_splits, write_table
from tallyframe.storage import settle


def prepare(
    raw: DataFrame,
    key: str,
    text_col: str,
    tasks: Sequence[str],
    stratify_on: str,
    out: str,
    flags: Mapping[str, Mapping[str, str]] | None = None,
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Clean, encode, split and report; returns the tables it wrote.

    ``raw`` needs a unique ``key`` column (a source row number or id).
    """
    clean = normalise_labels(raw, tasks)
    for column, mapping in (flags or {}).items():
        clean = map_labels(clean, column, mapping)
    clean = settle(drop_incomplete(clean, [text_col, *tasks]), "clean")
    encoder = fit_encoder(unpivot_labels(clean, [key], tasks))
    encoded = encode_wide(clean, encoder, tasks)
    split = stratified_split(encoded, key, stratify_on, ratios, seed)
    write_encoder(encoder, f"{out}/encoder")
    write_splits(split, f"{out}/splits")
    split = raw.sparkSession.read.parquet(f"{out}/splits")
    info = split_info(split, seed, stratify_on, tasks)
    write_table(info, f"{out}/split_info", "json")
    train = unpivot_labels(split.where(F.col("split") == "train"), [key], tasks)
    return {
        "encoder": encoder,
        "splits": split,
        "split_info": info,
        "imbalance": imbalance_report(train),
    }
