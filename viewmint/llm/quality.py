"""Quality classifier: regularised quadratic discriminant analysis.

Each class is a Gaussian over transformed document statistics.  Its covariance
shrinks towards the covariance pooled over the classes and then towards a
multiple of the identity.  The factors of the class covariances are computed
once, at fitting; a score is the logistic of the difference of log densities,
each a Mahalanobis norm by the cached factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, row_key, stored, without

#: Shrinkage towards the pooled covariance, and then towards the identity.
TO_POOLED, TO_IDENTITY = 0.1, 0.02
#: Characters of markup, tables, code and noise, which prose has few of.
MARKS = r"#$%&*|<>{}\[\]\\^~`"
#: A document is kept if its score is at least this.
KEEP_FROM = 0.3


def _count(text: Column, kept: str) -> Column:
    """Characters of ``text`` that a class of characters has."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("double")


def statistics(text: Column) -> list[Column]:
    """Transformed statistics of a whole text, all finite, for the empty too."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = F.size(words).cast("double")
    chars = F.length(text).cast("double")
    pairs = F.zip_with(
        words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: (a == b).cast("int")
    )
    again = F.aggregate(pairs, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))).cast("double")
    short = F.size(F.filter(words, lambda w: F.length(w) <= 3)).cast("double")

    def rate(x: Column, of: Column, usual: float, trust: float) -> Column:
        """Log of a share that starts at ``usual`` and follows the text as its
        length passes ``trust``: short texts tell little about themselves."""
        return F.log(F.lit(0.002) + (x + usual * trust) / (of + trust))

    return [
        F.log1p(n),
        rate(F.size(F.array_distinct(words)).cast("double"), n, 0.8, 10),
        rate(again, n, 0.01, 10),
        rate(short, n, 0.4, 10),
        rate(_count(text, r"A-Z"), chars, 0.03, 60),
        rate(_count(text, MARKS), chars, 0.002, 60),
        rate(_count(text, r"!?"), chars, 0.001, 60),
        rate(_count(text, r".,;:"), chars, 0.02, 60),
        rate(_count(text, r"0-9"), chars, 0.003, 60),
        F.log((chars + 60) / (n + 10)),
    ]


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, row_hash, _x): the statistics of every row; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col)[1].alias("row_hash"), F.array(*statistics(text)).alias("_x"))


@dataclass(frozen=True)
class Discriminant:
    """Two fitted Gaussians; index 0 and 1 are the classes."""

    means: np.ndarray
    roots: np.ndarray  # inverse Cholesky factors
    offsets: np.ndarray  # log prior minus half the log determinant

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        at = []
        for mean, root, offset in zip(self.means, self.roots, self.offsets):
            z = (x - mean) @ root.T
            at.append(offset - 0.5 * np.einsum("ij,ij->i", z, z))
        return at[1] - at[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, sums and sums of products of a partition, one row a class."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        y = batch.column("label").to_numpy(zero_copy_only=False)
        x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        one = np.c_[np.ones(len(y)), x]
        for c in np.unique(y):
            part = one[y == c]
            total[int(c)] = total.get(int(c), 0) + part.T @ part
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(total), pa.int32()),
            pa.array([list(m.ravel()) for m in total.values()], pa.list_(pa.float64())),
        ],
        ["label", "products"],
    )


def fit(labelled: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """Fits to (label 0 or 1, _x array).  A class without rows gets the pooled
    mean and covariance; with no rows at all every score is one half."""
    parts = labelled.select(F.col("label").cast("int").alias("label"), "_x").mapInArrow(
        _moments, "label int, products array<double>"
    )
    summed = (
        parts.select("label", F.posexplode("products").alias("at", "v"))
        .groupBy("label", "at")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    if not summed:
        return Discriminant(np.zeros((2, 1)), np.zeros((2, 1, 1)), np.zeros(2))
    wide = int(round((max(r["at"] for r in summed) + 1) ** 0.5))
    products = np.zeros((2, wide, wide))
    for r in summed:
        if r["label"] in (0, 1):
            products[r["label"], r["at"] // wide, r["at"] % wide] = r["v"]
    both = products.sum(axis=0)
    n, p = products[:, 0, 0], wide - 1
    grand = both[0, 1:] / both[0, 0]
    means = np.array([products[c, 0, 1:] / n[c] if n[c] else grand for c in (0, 1)])
    own = np.array(
        [
            products[c, 1:, 1:] / n[c] - np.outer(means[c], means[c])
            if n[c]
            else both[1:, 1:] / both[0, 0] - np.outer(grand, grand)
            for c in (0, 1)
        ]
    )
    pooled = (own * np.maximum(n, 0)[:, None, None]).sum(axis=0) / n.sum()
    roots, offsets = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * own[c] + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * (np.trace(pooled) / p + 1e-6) * np.eye(p)
        factor = np.linalg.cholesky(cov)
        roots.append(np.linalg.inv(factor))
        offsets.append(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(roots), np.array(offsets))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Scores every row's whole text; higher: label 1 likelier.

    Fits to all labelled rows whose crc32(id as text) mod 5 isn't 0: the fit
    needs sums of products only, which tasks add up on their own.  An id with
    contradicting labels, a null label or id is not learnt from.  Null and empty texts are scored as texts without words; rows
    that repeat score alike; an empty table gives an empty result.

    Returns ``id_col, held_out, score, predicted`` and ``row_hash``, a hash of
    the text, which tells rows of one id apart.
    """
    fold = F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit(""))) % 5
    every = stored(features(docs, id_col, text_col), "statistics")
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("label"), F.max(label_col).alias("_most"))
        .where("label = _most")
        .where(fold != 0)
        .select("_id", "label")
    )
    model = fit(every.join(known, "_id").select("label", "_x"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            s = model.scores(x) if model.means.shape[1] == x.shape[1] else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("held_out"), pa.array(s), pa.array((s >= KEEP_FROM).astype(np.int32)), batch.column("row_hash")],
                [id_col, "held_out", "score", "predicted", "row_hash"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return every.select("_id", (fold == 0).alias("held_out"), "_x", "row_hash").mapInArrow(
        score, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, row_hash long"
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted to be of low quality.

    Each row stays or goes by its own text, also where ids repeat or are null.
    All columns are kept; null and empty texts are scored as texts without
    words; an empty table gives an empty result.
    """
    scored = quality_scores(docs, labels, id_col, text_col).where("predicted = 0")
    bad = scored.select(F.col(id_col).alias("_key_id"), F.col("row_hash").alias("_key_text"))
    return without(docs, bad, id_col, text_col)
