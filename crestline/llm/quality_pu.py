"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled 1; all other training text counts as unlabelled. The
class prior is estimated from the two samples, and a linear model over standardised text features
is fitted by gradient steps on the non-negative unbiased risk: the risk of the negatives, the
unlabelled risk less the prior times that of positives taken as negatives, never goes below zero.

Null and empty texts have features of their own and a score like any text. Repeated rows give
equal scores. Without trusted positives or without unlabelled rows every score is the prior, 0.5.
An empty table gives an empty result. Columns other than id, text and label are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.profile import CLASSES, base_counts, class_counts, words_of
from crestline.llm.shared import at_most, drawn, short_batches

#: Rows of either training sample, at most; chosen by a hash of id and text.
MAX_POSITIVES, MAX_UNLABELLED = 8_000, 16_000
N_FEATURES = len(CLASSES) + 16


def features(text: str | None) -> np.ndarray:
    """Shares and logarithms that describe one whole text, whatever its language."""
    text = text or ""
    words = words_of(text)
    n, chars, symbols, dup_lines, repeated = base_counts(text, words)
    classes = class_counts(text)
    lines = text.count("\n") + 1
    m = max(1, n)
    times = Counter(words)
    distinct, common = len(times), max(times.values(), default=0)
    most = max(1, text.count(".") + text.count("?"))
    ends = sum(w[-1:] in b"!%$#&*|<>" for w in words)
    return np.array(
        [*(classes / max(1, len(text))), np.log1p(n), chars / m, symbols / m, dup_lines / lines, repeated / m, distinct / m, np.log1p(distinct), np.log1p(n / lines), np.log1p(n / most), ends / m, float(n == 0), np.log1p(m / max(1, distinct)), common / m, sum(len(w) <= 3 for w in words) / m, sum(len(w) == 1 for w in words) / m, sum(w[-1:] in b".," for w in words) / m],
        np.float64,
    )


def _bent(z: np.ndarray) -> np.ndarray:
    """Standardised features, and how far each is from the middle on either side: junk may have too much or too little of a thing."""
    z = np.clip(z, -5, 5)
    return np.hstack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])


@dataclass
class PuModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = _bent((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(pos: np.ndarray, unl: np.ndarray, prior: float, unbiased: bool, steps: int = 400, rate: float = 0.07, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the logistic risk: non-negative unbiased, or plain positive against unlabelled."""
    d = pos.shape[1]
    theta, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    p1, u1 = np.hstack([pos, np.ones((len(pos), 1))]), np.hstack([unl, np.ones((len(unl), 1))])
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = p1 @ theta, u1 @ theta
        as_pos, as_neg, unl_neg = -(p1 * sig(-zp)[:, None]).mean(0), (p1 * sig(zp)[:, None]).mean(0), (u1 * sig(zu)[:, None]).mean(0)
        if not unbiased:
            g = 0.5 * as_pos + 0.5 * unl_neg
        else:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g = prior * as_pos + (unl_neg - prior * as_neg) if negative >= 0 else -(unl_neg - prior * as_neg)
        g = g + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the two samples' shares above any score that keeps 30 % of the positives.

    pos and unl are scores of a plain positive-against-unlabelled model on rows it was not fitted on.
    """
    best = 1.0
    for cut in np.quantile(pos, np.linspace(0, 0.7, 36)):
        best = min(best, (unl >= cut).mean() / max(1e-9, (pos >= cut).mean()))
    return float(min(0.99, max(0.05, best)))


def fit(pos: np.ndarray, unl: np.ndarray) -> PuModel:
    d = N_FEATURES
    if not len(pos) or not len(unl):
        return PuModel(np.zeros(d), np.ones(d), np.zeros(3 * d), 0.0, 0.5)
    mean, scale = unl.mean(0), unl.std(0)
    scale[scale < 1e-9] = 1.0
    p, u = _bent((pos - mean) / scale), _bent((unl - mean) / scale)
    if len(p) >= 20 and len(u) >= 20:
        w, b = _descend(p[::2], u[::2], 0.5, False, steps=200)
        prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b)
    else:
        prior = 0.5
    w, b = _descend(p, u, prior, True)
    return PuModel(mean, scale, w, b, prior)


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    got = at_most(drawn(rows, most, "id", "text").select("_draw", vector(F.col("text"), rows).alias("x")), most).collect()
    return np.array([r["x"] for r in got]).reshape(-1, N_FEATURES)


def vector(text: Column, df: DataFrame) -> Column:
    short_batches(df.sparkSession)

    @F.pandas_udf("array<double>")
    def described(part: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in part], dtype=object)

    return described(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> PuModel:
    """docs are the rows that may be learned from. The two samples' sizes bound what reaches the driver: numbers, no texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    trusted = labels.where(F.col(label) == 1).select(F.col(id_col).alias("id")).distinct()
    return fit(_sample(rows.join(trusted, "id", "left_semi"), max_positives), _sample(rows, max_unlabelled))


def scored(text: Column, model: PuModel, df: DataFrame) -> Column:
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(part: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in part]).reshape(-1, N_FEATURES)
        return pd.Series(shared.value.score(x))

    return score(text)
