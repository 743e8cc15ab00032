"""Toxicity as ordered grades of severity, by cumulative-link regression.

Features of a text are its words (lower case, outer punctuation off) and the
words' first 4, 5 and 6 letters, hashed and counted.  One weight vector is
shared by all thresholds: P(grade >= j) = sigmoid(weights . x - threshold_j)
with rising thresholds, fitted by maximum likelihood with an L1 penalty (so
that words that tell nothing weigh nothing, however long the text), and the
severity of a text is the expected grade, the sum of those probabilities.

``labels`` only tell toxic from not, so the grades of the toxic rows come from
the sample itself: how many of a text's words carry a feature far more common
in toxic rows, cut at the thirds (1 mild, 2 strong, 3 severe); 0 is not toxic.

The model is fitted on at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN``
other labelled rows (an id and text each, those of smallest id hash); scoring reads every text once
and shuffles nothing.

Defined cases: a null or empty text has no features and the lowest severity of
the model; without labelled rows of both kinds nothing is toxic; null labels
and labels of unknown documents are left out; rows that repeat an id are
scored each; other columns are carried along unchanged.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.arrow import pieces
from tillroll.llm.memo import Memo
from tillroll.llm.tables import written

SAMPLE_TOXIC, SAMPLE_CLEAN = 2_000, 4_000
SIZE = 1 << 18
GRADES = 3
#: A feature marks toxic rows when its log odds are at least this.
MARKED = 2.0
#: Features whose log odds are nearer to none than this get no weight.
TELLING = 0.7
#: Rate of the weights' Laplace prior: the L1 penalty on the mean loss is this
#: over the sample's size.
PENALTY = 1.0
ROUNDS = 200
_EDGE = ".,;:!?\"'()[]{}|<>*_-"


def features(token: str) -> tuple[int, ...]:
    """Hashed features of one white-space token of a lower-case text; the last
    two bits tell a whole word (0) from its first 4, 5 or 6 letters (1, 2, 3)."""
    word = token.strip(_EDGE)
    if not word:
        return ()
    parts = [(0, word), *((n - 3, word[:n]) for n in (4, 5, 6) if len(word) >= n)]
    return tuple(zlib.crc32(f"{kind} {part}".encode("utf-8", "surrogatepass")) % (SIZE // 4) * 4 + kind for kind, part in parts)


def text_features(text: str | None) -> np.ndarray:
    """(feature, number of words with it), as two rows."""
    counts: dict[int, int] = {}
    for token, n in Counter((text or "").lower().split()).items():
        for f in features(token):
            counts[f] = counts.get(f, 0) + n
    return np.array(sorted(counts.items()), dtype=np.int32).reshape(-1, 2).T


@dataclass
class Model:
    weights: np.ndarray  # by feature
    thresholds: np.ndarray  # rising
    cut: float  # least score that counts as toxic

    def reach(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, int]]:
    """(features, toxic) of the bounded sample."""
    rated = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    said = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("said")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", said)
    # a row each id and text, so that an id with very many rows stays within the bound
    rated = written(docs.select("doc_id", "said").distinct().join(rated, "doc_id"), "rated")

    def some(toxic: int, n: int) -> DataFrame:
        return rated.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id", "said").limit(n)

    sample = F.broadcast(some(1, SAMPLE_TOXIC).union(some(0, SAMPLE_CLEAN)))  # at most 6,000 rows

    def encode(batches):
        for batch in pieces(batches, 1):
            found = [text_features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "x"])

    rows = docs.join(sample, ["doc_id", "said"]).dropDuplicates(["doc_id", "said"]).select("doc_id", "text", F.col("toxic").cast("long"))
    rows = rows.mapInArrow(encode, "doc_id long, toxic long, x binary").orderBy("doc_id", "x").toArrow()
    once = dict(zip(rows.column("x").to_pylist(), rows.column("toxic").to_pylist(), strict=True))  # copies tell nothing more
    return [(np.frombuffer(x, dtype=np.int32).reshape(2, -1), toxic) for x, toxic in once.items()]


def log_odds(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """How much more common each feature is in toxic rows; 0 where under three
    toxic rows have it."""
    n = [sum(t == kind for _, t in rows) for kind in (0, 1)]
    seen = np.zeros((2, SIZE))
    for x, t in rows:
        seen[t, x[0]] += 1
    odds = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    return np.where(seen[1] >= 3, odds, 0)


def grades(rows: list[tuple[np.ndarray, int]], odds: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic, 1 to ``GRADES`` by how marked they are."""
    toxic = np.array([t for _, t in rows])
    # a word counts once: by itself, or by its stem where more words share that
    by_kind = [(odds >= MARKED) & (np.arange(SIZE) % 4 == kind) for kind in range(4)]
    strength = np.array([max(x[1][m[x[0]]].sum() for m in by_kind) for x, _ in rows])
    cuts = np.quantile(strength[toxic == 1], np.arange(1, GRADES) / GRADES)
    return np.where(toxic == 1, 1 + (strength[:, None] > cuts[None, :]).sum(axis=1), 0)


def fit(rows: list[tuple[np.ndarray, int]]) -> Model:
    """Proximal gradient with momentum on the cumulative-link likelihood."""
    none = Model(np.zeros(SIZE, dtype=np.float32), np.full(GRADES, 30.0), np.inf)
    if len({t for _, t in rows}) < 2:
        return none
    odds = log_odds(rows)
    grade = grades(rows, odds)
    used = np.flatnonzero(np.abs(odds) >= TELLING)
    place = np.full(SIZE, -1)
    place[used] = np.arange(len(used))
    row = np.concatenate([np.full(x.shape[1], i) for i, (x, _) in enumerate(rows)])
    column = place[np.concatenate([x[0] for x, _ in rows])]
    value = np.log1p(np.concatenate([x[1] for x, _ in rows]).astype(np.float64))
    row, column, value = row[column >= 0], column[column >= 0], value[column >= 0]
    n, d = len(rows), len(used)

    # thresholds: the first, then steps kept positive by an exponential
    theta = np.concatenate([np.zeros(d), [2.0], np.zeros(GRADES - 1)])
    ahead, momentum, step, penalty, still = theta.copy(), 1.0, 0.05, PENALTY / n, 0

    def thresholds(t: np.ndarray) -> np.ndarray:
        return t[d] + np.concatenate([[0.0], np.cumsum(np.exp(t[d + 1 :]))])

    def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
        score = np.bincount(row, weights=value * t[column], minlength=n)
        cut = thresholds(t)
        reach = _sigmoid(score[:, None] - cut[None, :])
        edge = np.concatenate([np.ones((n, 1)), reach, np.zeros((n, 1))], axis=1)
        each = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-12)
        slope = edge * (1 - edge)
        by_score = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / each / n
        by_cut = np.zeros(GRADES)
        for j in range(GRADES):
            s = slope[:, j + 1] / each / n
            by_cut[j] = s[grade == j + 1].sum() - s[grade == j].sum()
        gradient = np.empty_like(t)
        gradient[:d] = np.bincount(column, weights=value * by_score[row], minlength=d)
        gradient[d] = by_cut.sum()
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient[d + 1 :] = tail[1:] * np.exp(t[d + 1 :])
        return float(-np.log(each).mean()), gradient

    for _ in range(ROUNDS):
        at, gradient = loss(ahead)
        while True:
            new = ahead - step * gradient
            new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * penalty, 0)
            move = new - ahead
            if loss(new)[0] <= at + gradient @ move + move @ move / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - theta)
        still = still + 1 if np.abs(new - theta).max() < 1e-3 else 0
        theta, momentum, step = new, following, step * 1.5
        if still == 5:
            break
    weights = np.zeros(SIZE, dtype=np.float32)
    weights[used] = theta[:d]
    score = np.bincount(row, weights=value * theta[column], minlength=n)
    return Model(weights, thresholds(theta), least_wrong(score, grade > 0))


def least_wrong(score: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the fewest errors on the sample, in the middle of the widest
    such gap between scores."""
    order = np.argsort(score, kind="stable")
    s, t = score[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum(~t[::-1])[::-1], [0]])
    edge = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    gap = edge[1:] - edge[:-1]
    best = max(np.flatnonzero(gap > 0), key=lambda i: (-errors[i], gap[i]))
    return float((edge[best] + edge[best + 1]) / 2)


class _Weights(Memo):
    """token -> (features that weigh anything)."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__(self.of)
        self.weights = weights

    def of(self, token: str) -> tuple[int, ...]:
        return tuple(f for f in features(token) if self.weights[f])


def text_score(text: str | None, known: _Weights) -> float:
    counts: dict[int, int] = {}
    for found in map(known.__getitem__, (text or "").lower().split()):
        for f in found:
            counts[f] = counts.get(f, 0) + 1
    return float(sum(known.weights[f] * np.log1p(n) for f, n in sorted(counts.items())))


NAMES = ("_severity", "_grade", "_toxic")


def with_severity(docs: DataFrame, model: Model, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """All columns, then three named ``names``: the expected grade, the grade (0,
    or the most likely one of a toxic text) and whether the text is toxic (the
    score reaches the cut that was least often wrong on the sample); columns of
    those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    schema = docs.withColumns(dict(zip(names, (F.lit(0.0), F.lit(0), F.lit(False)), strict=True))).schema

    def score(batches):
        fitted = shared.value
        known = _Weights(fitted.weights)
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            scores = np.array([text_score(t, known) for t in texts], dtype=np.float64)
            reach, toxic = fitted.reach(scores), scores >= fitted.cut
            above = np.concatenate([reach, np.zeros((len(texts), 1))], axis=1)
            likely = 1 + np.argmax(above[:, :-1] - above[:, 1:], axis=1)
            grade = np.where(toxic, likely, 0).astype(np.int32)
            out = [*batch.columns, pa.array(reach.sum(axis=1)), pa.array(grade), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, *names])

    return docs.mapInArrow(score, schema)


def severity(docs: DataFrame, labels: DataFrame, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with the three columns of ``with_severity``, the model fitted on
    the labelled ones."""
    return with_severity(docs, fit(training_rows(docs, labels)), names)
