"""Quality classifier by positive-unlabelled learning.

The model sees trusted positives (documents labelled good) and unlabelled web text, never
a negative example. With an estimated class prior the risk of the unseen negatives is the
risk of all text less that of the positives; where that estimate falls below zero the
step is taken against it, so the risk stays non-negative and the model does not overfit.

Each text is turned into a few measures of form, and the model is a small network over those. The trusted positives of
the fit are a bounded sample. Unlabelled text enters the risk whole: every row counts in one of a fixed number of cells,
and a cell stands in the risk with its mean measures and its count. The class prior is estimated from the scores of all rows.
Measures of the training rows are stored once; what reaches the driver is bounded by the sample and the cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import Stored, column

#: Largest number of positives that the fit looks at.
SAMPLE = 20_000
#: Cells that all unlabelled documents are gathered in; each holds those nearest to one of so many of them.
CELLS = 2048
HIDDEN = 16
STEPS = 1500
BATCH = 1024
RATE = 0.01
FOLDS, HELD_OUT = 3, 1

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "break": b"\n",
    "stop": b".,;:?",
    "bang": b"!",
    "symbol": b"#*$%&<>@^~=+_",
    "bar": b"|",
    "bracket": b"()[]{}/\\\"'`-",
    "high": bytes(range(128, 256)),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _MEMBER[list(_members), _i] = 1
N_FEATURES = len(_CLASSES) + 10


def features(text: str | None) -> np.ndarray:
    """Measures of one whole text; none depends on a label, language, source or id."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(raw, minlength=256) @ _MEMBER / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    full = [line for line in lines if line]
    return np.array(
        [
            *share,
            np.log1p(len(text)),
            np.log1p(len(words)),
            (len(raw) - share[3] * len(raw)) / n / 10,
            distinct / n,
            pairs / n,
            np.log1p(n) * distinct / n,
            sum(map(eq, words, words[1:])) / n,
            len(set(full)) / max(1, len(full)),
            np.log1p(n / max(1, len(full))),
            float(not words),
        ]
    )


class Model:
    """A network of one hidden layer over standardised measures."""

    def __init__(self, middle: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.middle, self.scale, self.weights = middle, scale, weights

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        z = np.clip((x - self.middle) / self.scale, -6, 6)
        h = np.tanh(z @ a + b)
        return z, h, h @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x)[2], -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, counts: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Minimise the non-negative unbiased risk with logistic loss (Adam, numpy).

    A row of ``unlabelled`` stands for as many documents as ``counts`` says.
    """
    rng = np.random.default_rng(seed)
    weights = np.concatenate([np.full(len(positive), 0.5 / len(positive)), 0.5 * counts / counts.sum()])
    every = np.vstack([positive, unlabelled])
    middle = weights @ every
    spread = (weights @ (every - middle) ** 2) ** 0.5
    below = np.cumsum(counts)
    shape = [(N_FEATURES, HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    start = [rng.normal(0, 1 / np.sqrt(N_FEATURES), shape[0]), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(())]
    model = Model(middle, spread + 1e-6, start)
    first, second = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape]

    def sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    for step in range(1, STEPS + 1):
        p = positive[rng.integers(0, len(positive), BATCH)]
        u = unlabelled[np.searchsorted(below, rng.integers(0, below[-1], BATCH), side="right")]
        z, h, g = model.raw(np.vstack([p, u]))
        gp, gu = g[:BATCH], g[BATCH:]
        # log-loss as a positive is softplus(-g), as a negative softplus(g)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # derivative by g of each part
        down_p, down_u = -prior * sigmoid(gp) / BATCH, sigmoid(gu) / BATCH
        if negative >= 0:
            dg = np.concatenate([-prior * sigmoid(-gp) / BATCH + down_p, down_u])
        else:
            dg = -np.concatenate([down_p, down_u])
        a, b, c, d = model.weights
        dh = np.outer(dg, c) * (1 - h * h)
        grads = [z.T @ dh + 1e-4 * a, dh.sum(0), h.T @ dg + 1e-4 * c, dg.sum()]
        rate = RATE * (1 - step / (STEPS + 1))
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            model.weights[i] = model.weights[i] - rate * (first[i] / (1 - 0.9**step)) / (
                np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
            )
    return model


def prior_cuts(positive: np.ndarray) -> np.ndarray:
    """Scores that half of the positives or more pass."""
    return np.quantile(positive, np.linspace(0, 0.5, 51))


def estimated_prior(positive: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: int) -> float:
    """Share of positives among ``n`` unlabelled documents, of which ``above`` reach each of ``cuts``.

    Above any cut, unlabelled text holds at least its positives' share of what positives have there, so the least ratio
    of the two tails is an upper bound that is tight where negatives are absent. Only cuts that half of the positives pass count. The least of several
    noisy ratios is too low, so each counts with its standard error added.
    """
    tails = [(a / n, (positive >= c).mean()) for c, a in zip(cuts, above)]
    return float(min((u + (u * (1 - u) / n) ** 0.5) / p for u, p in tails if p > 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, N_FEATURES)


def _gathered(rows: DataFrame, seeds: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean measures and count of the rows nearest to each seed; cells without rows are left out."""
    size = 1024  # rows at once: their distances to all seeds take 16 MB

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task answers with a row per cell, however many rows it holds
        counts, sums = np.zeros(len(seeds), np.int64), np.zeros((len(seeds), N_FEATURES))
        z = np.clip((seeds - middle) / scale, -6, 6)
        norms = (z * z).sum(1)
        for batch in batches:
            for at in range(0, len(batch), size):
                x = _matrix(batch["x"].iloc[at : at + size])
                v = np.clip((x - middle) / scale, -6, 6)
                far = 2 * v @ z.T
                cell = np.subtract(norms, far, out=far).argmin(1)
                counts += np.bincount(cell, minlength=len(seeds))
                np.add.at(sums, cell, x)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": some.astype("int32"), "n": counts[some], "sums": list(sums[some])})

    parts = rows.select("x").mapInPandas(partial, "cell int, n bigint, sums array<double>")
    totals = [F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(N_FEATURES)]
    found = parts.groupBy("cell").agg(F.sum("n").alias("n"), *totals).toPandas().sort_values("cell")
    counts = found["n"].to_numpy()
    return found[[f"s{i}" for i in range(N_FEATURES)]].to_numpy() / counts[:, None], counts


def _above(rows: DataFrame, model: Model, cuts: np.ndarray) -> np.ndarray:
    """How many rows score each of ``cuts`` or more."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(cuts), np.int64)
        for batch in batches:
            if len(batch):
                total += len(batch) - np.searchsorted(np.sort(model.score(_matrix(batch["x"]))), cuts, side="left")
        yield pd.DataFrame({"cut": np.arange(len(cuts), dtype="int32"), "n": total})

    found = rows.select("x").mapInPandas(count, "cut int, n bigint").groupBy("cut").agg(F.sum("n").alias("n")).toPandas()
    return found.sort_values("cut")["n"].to_numpy()


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """Model from the documents outside the held-out fold; None without any positive.

    Positives are documents all of whose labels are 1, unlabelled ones those without a label. The prior starts as the
    share of positives among labelled training documents and is then estimated from a first fit. Of an id that repeats, one row counts.
    The positives are the first ``SAMPLE`` by hash of the id; of the unlabelled documents all count.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(t).astype("<f8").tobytes() for t in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"].to_numpy(), "x": x})

    store = Stored(docs.sparkSession)
    rows = docs.select(column(doc_id).cast("bigint").alias("_id"), column(text).cast("string").alias("_text"))
    rows = rows.filter((fold(F.col("_id")) != HELD_OUT) & F.col("_id").isNotNull())
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q"))
    measured = rows.mapInPandas(measure, "_id bigint, x binary").groupBy("_id").agg(F.min("x").alias("x"))
    known = store.keep(measured.join(marks, "_id", "left"))
    is_positive, is_open = F.col("_q") > 0, F.col("_q").isNull()
    share, n_open = known.agg(
        F.avg(F.when(F.col("_q").isNotNull(), is_positive.cast("double"))), F.count_if(is_open)
    ).first()
    if not share:
        return None
    unlabelled = known.filter(is_open) if n_open else known  # everything is labelled: all text takes that part
    order = F.xxhash64("_id")

    def first(df: DataFrame, size: int) -> np.ndarray:
        return _matrix(df.orderBy(order, "_id").limit(size).select("x").toPandas()["x"])

    positive, seeds = first(known.filter(is_positive), SAMPLE), first(unlabelled, CELLS)
    cells, counts = _gathered(unlabelled, seeds, seeds.mean(0), seeds.std(0) + 1e-6)
    prior = float(share)
    model = fit(positive, cells, counts, prior)
    mine = model.score(positive)
    cuts = prior_cuts(mine)
    prior = min(prior, estimated_prior(mine, cuts, _above(unlabelled, model, cuts), int(counts.sum())))
    store.drop(known)
    return fit(positive, cells, counts, prior)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as struct ``_row``, with ``score``: the probability that its quality is 1.

    Null or empty text is scored like any other, by its measures. Repeated rows get equal
    scores. Without positives to learn from every score is 0.5. No rows give no rows.
    """
    model = train(docs, labels, doc_id, text)
    rows = docs.select(F.struct("*").alias("_row"), column(text).cast("string").alias("_text"))
    if model is None:
        return rows.select("_row", F.lit(0.5).alias("score"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.vstack([features(t) for t in texts])))

    return rows.select("_row", score("_text").alias("score"))


def filter_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows scored 0.5 or more, with the columns they came with."""
    return scored(docs, labels, doc_id, text).filter(F.col("score") >= 0.5).select("_row.*")
