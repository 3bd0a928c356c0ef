"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and their beginnings of 4 to 6 letters, hashed to
`BUCKETS` numbers. The score is sigmoid(bias + weights of the terms present + inner products of the
factors of all pairs of them), so that two terms together can weigh more (or less) than their sum.

The model is fitted on at most `MAX_ROWS` labelled rows, one an id (that of the least text hash), and
`MAX_SAMPLE_TERMS` terms in them (the first rows by a hash of the id; a bounded sample by design), on all terms of
whole texts, by minibatch AdaGrad in the driver. Every weight pays a
penalty on its size and every term's factors one on their length (`WEIGHT_PENALTY`,
`FACTOR_PENALTY`), so that a term without use ends at exactly 0; the factors' is low enough that two terms
keep theirs that tell nothing apart and everything together. Scoring reads whole texts of all rows.

Null text counts as empty and scores what no term scores; unlabelled rows (null) are not learned
from; without labelled rows of both kinds every score is the share of the label. Extra columns are
ignored, repeated rows stay repeated, empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, give_back, map_rows, ship, stored

BUCKETS = 1 << 20
MAX_ROWS = 12_000
#: Distinct terms of all sampled rows together (four bytes each on the driver): of rows so long that
#: `MAX_ROWS` of them hold more, fewer are sampled.
MAX_SAMPLE_TERMS = 64_000_000
RANK = 4
EPOCHS = 10
#: Least minibatches of a fit: a small sample is read more often.
STEPS = 1_500
BATCH = 64
WEIGHT_PENALTY = 1e-3
#: Of 5e-3, 1e-2 and 2e-2 the one of least mean loss in four folds of the training rows (sf0.1).
FACTOR_PENALTY = 1e-2
SEED = 11
WORDS = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6)


def word_terms(word: str) -> list[int]:
    """Hashed terms of a lower-cased word: itself and its beginnings."""
    found = ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in found]


def text_words(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def fold(key: Column) -> Column:
    """crc32 of a key's decimal text, mod 5: remainder 0 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


class Model:
    """Bias, weights and factors of the chosen terms."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.index = {int(t): i for i, t in enumerate(terms)}
        self.bias, self.weights, self.factors = bias, weights, factors
        self.squares = (factors**2).sum(axis=1)
        self.words: dict[str, tuple[int, ...]] = {}

    def terms(self, text: str | None) -> list[int]:
        """Places of the text's terms that the model knows."""
        found: set[int] = set()
        if len(self.words) > 100_000:
            self.words.clear()
        known = self.words
        for w in text_words(text):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(self.index[t] for t in word_terms(w) if t in self.index)
            found.update(own)
        return sorted(found)

    def score(self, text: str | None) -> float:
        x = self.terms(text)
        z = self.bias
        if x:
            v = self.factors[x].sum(axis=0)
            z += float(self.weights[x].sum() + 0.5 * (v @ v - self.squares[x].sum()))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def shrunk(w: np.ndarray, v: np.ndarray, gw: np.ndarray, gv: np.ndarray, steps: np.ndarray, rates: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and factors after the penalties of so many steps."""
    w = np.sign(w) * np.maximum(np.abs(w) - rates[0] / np.sqrt(gw) * WEIGHT_PENALTY * steps, 0)
    lengths = np.sqrt((v**2).sum(axis=1)) + 1e-30
    return w, v * np.maximum(1 - rates[1] / np.sqrt(gv) * FACTOR_PENALTY * steps / lengths, 0)[:, None]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> Model:
    """Logistic factorization machine of all terms, by minibatch AdaGrad with proximal penalties."""
    labels = np.asarray(labels, dtype=float)
    share = float(labels.mean()) if len(labels) else 0.0
    prior = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    ends = np.cumsum([0, *map(len, rows)])
    if not 0 < share < 1 or not ends[-1]:
        return Model(np.zeros(0, dtype=np.int64), prior, np.zeros(0), np.zeros((0, RANK)))
    flat = np.concatenate(rows)
    counts = np.bincount(flat, minlength=BUCKETS)
    terms = np.flatnonzero(counts)
    places = np.cumsum(counts > 0, dtype=np.int32) - 1
    flat = places[flat]
    m, rng = len(terms), np.random.default_rng(seed)
    w, v, b = np.zeros(m), rng.normal(0, 0.05, (m, RANK)), prior
    gw, gv, gb = np.full(m, 0.01), np.full(m, 0.01), 1e-6
    balance = np.where(labels > 0, min(5.0, 0.5 / share), 1.0)
    rate, rate_v = rates = (0.1, 0.05)
    # penalties are made up for when a term is next seen, and at the end
    last, step = np.zeros(m, dtype=np.int64), 0
    flag, place = np.zeros(m, dtype=bool), np.zeros(m, dtype=np.int64)  # of a minibatch's terms
    filled = np.flatnonzero(np.diff(ends))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(filled)))):
        order = rng.permutation(filled)
        for at in range(0, len(order), BATCH):
            step += 1
            i = order[at : at + BATCH]
            n = ends[i + 1] - ends[i]
            starts = np.cumsum(n) - n
            x = np.concatenate([flat[ends[j] : ends[j + 1]] for j in i])
            flag[x] = True
            seen = np.flatnonzero(flag)
            flag[seen], place[seen] = False, np.arange(len(seen))
            x = place[x]
            ws, vs = shrunk(w[seen], v[seen], gw[seen], gv[seen], step - last[seen], rates)
            last[seen] = step
            vx = vs[x]
            s = np.add.reduceat(vx, starts, axis=0)
            z = b + np.add.reduceat(ws[x], starts) + 0.5 * ((s**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
            d = balance[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) / len(i)
            dw = np.bincount(x, np.repeat(d, n), len(seen))
            dv = np.stack([np.bincount(x, np.repeat(d * s[:, f], n), len(seen)) for f in range(RANK)], axis=1) - dw[:, None] * vs
            gw[seen] += dw**2
            gv[seen] += (dv**2).mean(axis=1)
            gb += d.sum() ** 2
            w[seen] = ws - rate * dw / np.sqrt(gw[seen])
            v[seen] = vs - rate_v * dv / np.sqrt(gv[seen])[:, None]
            b -= rate * d.sum() / np.sqrt(gb)
    w, v = shrunk(w, v, gw, gv, step - last, rates)
    # what is 0 adds nothing to any score
    used = (w != 0) | (v != 0).any(axis=1)
    return Model(terms[used], float(b), w[used], v[used])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled rows that are not held out, at most `max_rows` of them and
    `MAX_SAMPLE_TERMS` terms."""
    key = F.col(id_col)
    learn = labels.filter((fold(key) != 0) & F.col(label_col).isNotNull() & key.isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y_"))
    learn = learn.withColumn("rank_", F.xxhash64(id_col, F.lit(SEED))).orderBy("rank_", id_col).limit(max_rows).withColumnRenamed(id_col, "id_")

    def make():
        def rows(keys, texts, ys, ranks):
            for key, text, y, rank in zip(keys, texts, ys, ranks, strict=True):
                yield key, y, rank, sorted({t for w in text_words(text) for t in word_terms(w)})

        return rows

    # at most max_rows ids are broadcast; repeats of an id are one row before anything is gathered
    found = docs.select(key, F.col(text_col).alias("text_")).join(F.broadcast(learn), key == F.col("id_"))
    one = F.min_by(F.struct("text_", "y_", "rank_"), F.xxhash64("text_")).alias("row_")
    sample = found.groupBy("id_").agg(one).select("id_", "row_.text_", "row_.y_", "row_.rank_")
    kind = docs.schema[id_col].dataType.simpleString()
    sample = stored(map_rows(sample, make, f"id_ {kind}, y_ int, rank_ long, terms array<int>"), "toxicity-sample")
    sizes = sorted((r[1], r[0], r[2]) for r in sample.select("id_", "rank_", F.size("terms")).collect())
    upto, total = len(sizes), 0
    for k, (*_, n) in enumerate(sizes):
        total += n
        if total > MAX_SAMPLE_TERMS:
            upto = k
            break
    if upto < len(sizes):
        last, key, _ = sizes[upto]
        sample = sample.filter((F.col("rank_") < last) | (F.col("rank_") == last) & (F.col("id_") < key))
    got = sample.select("id_", "y_", "terms").toArrow().combine_chunks().sort_by("id_")
    terms = got["terms"].combine_chunks()
    flat, ends = terms.values.to_numpy(zero_copy_only=False), terms.offsets.to_numpy()
    return fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], got["y_"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast((np.array(list(model.index), dtype=np.int64), model.bias, model.weights, model.factors))

    def make():
        own = Model(*shared.value)

        def rows(keys, texts):
            for key, text in zip(keys, texts, strict=True):
                yield key, own.score(text)

        return rows

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, score double")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores below `threshold`."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((np.array(list(model.index), dtype=np.int64), model.bias, model.weights, model.factors))
    place = docs.columns.index(text_col)

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keep = part.filter(pa.array([own.score(t) < threshold for t in part.column(place).to_pylist()], pa.bool_()))
                if keep.num_rows:
                    yield keep
        own = batch = part = keep = None
        give_back()

    return docs.mapInArrow(run, docs.schema)
