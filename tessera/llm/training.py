"""Bounded, labelled training samples shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of each class and bytes of a text that training may use at most. Scoring has no such bounds.
SAMPLE_PER_CLASS = 2000
SAMPLE_TEXT_BYTES = 16_000


def is_held_out(id_col):
    """Whether a row is held out of training: crc32 of the id as text leaves 2 modulo 4. A null id is."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", per_class: tuple[int, int] = (SAMPLE_PER_CLASS, SAMPLE_PER_CLASS)) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most per_class[y] rows of each class y, none of them held out.

    Rows are chosen by a hash of their id from all labelled ids with a text of at most SAMPLE_TEXT_BYTES, so
    the choice does not depend on how the tables are laid out, and long texts leave no gaps in it. Only ids
    travel until the choice is made; the chosen ids (sum(per_class) at most) are broadcast. Ids with several
    labels take the largest, ids with several fitting texts the first in order; both are settled by Spark, so
    the driver gets one row for each chosen id, however often the id is repeated.
    """
    ids = (
        labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y"))
        .where("_id is not null and _y in (0, 1)")
        .where(~is_held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t")).where(F.octet_length("_t") <= SAMPLE_TEXT_BYTES)
    fits = texts.select("_id").distinct().join(ids, "_id").withColumn("_h", F.xxhash64("_id"))
    chosen = fits.where("_y = 0").orderBy("_h", "_id").limit(per_class[0]).unionAll(fits.where("_y = 1").orderBy("_h", "_id").limit(per_class[1]))
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_h", "_y").agg(F.min("_t").alias("_t")).toPandas()
    rows = rows.sort_values(["_h", "_id"])
    return rows["_t"].tolist(), rows["_y"].to_numpy(dtype=np.int64)


def platt(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights (bias last) of a logistic regression of y on the columns of x, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.1 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def apply_platt(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
