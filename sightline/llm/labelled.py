"""A bounded sample of labelled rows, for the models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str | Column, folds: int = 5) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text, modulo folds, is 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, id_col: str, text_col: str, most: int, folds: int = 5) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `most` labelled rows that are not held out, chosen by a hash of the id.

    Rows with a null id, label or text are not chosen. An id that many
    documents repeat counts as often, within the bound.
    """
    some = labels.select(F.col(id_col).alias("_id"), label.cast("int").alias("_label")).where("_id is not null and _label is not null").where(~held_out("_id", folds))
    some = some.orderBy(F.xxhash64("_id", F.lit(3)), "_id", "_label").limit(most)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(some), "_id")
    found = found.select("_id", "_text", "_label").orderBy(F.xxhash64("_id", F.lit(3)), "_id", "_label", F.xxhash64("_text")).limit(most)
    rows = sorted(found.collect())
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
