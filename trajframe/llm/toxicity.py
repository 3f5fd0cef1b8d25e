"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are the distinct runs of letters in it, their beginnings, and the groups of letters within them: five
next to each other, or two in scripts that are written without spaces, so that a term is seen wherever it stands, also
joined to others by marks or by nothing. Marks, digits and white space separate runs. Severity has four ordered grades: 0 for texts labelled
clean; texts labelled toxic are graded 1 to 3 by thirds of how many features they have that set toxic texts apart.
One weight vector is shared by the three thresholds: P(grade > k) = sigmoid(w.x - t_k). Weights
are not negative, so that no amount of harmless text outweighs what is toxic. It is fitted with an L1 penalty on a
bounded sample of labelled rows (``MOST_PER_CLASS`` of each class, by hash of doc_id) and applied to all documents; the
sample's features are counted by Spark, and the driver gets only the at most ``MOST_FEATURES`` telling ones.
The outputs are the expected severity, the likeliest grade, and whether P(grade > 0) reaches ``REJECT_AT``.

Nulls: null text counts as empty; labels without doc_id or toxic are left out; of repeated labels a toxic one wins.
Without labels of both classes nothing is rejected. Repeated documents get a row each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import PieceMemo, by_size, numbered, stored

MOST_PER_CLASS = 4000
#: Features that the model may have: the most telling ones.
MOST_FEATURES = 16_384
REJECT_AT = 0.5
#: Features enter the model if they favour toxic texts and chance explains them with a probability under exp(-SCREEN) over all features together.
SCREEN = 1.0
GRADES = 4
_RUN = re.compile(r"[^\W\d_]+")
#: Letters of scripts without spaces between words: South-East Asian ones, kana, ideographs, and fullwidth forms of these.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")


def features(word: str) -> list[int]:
    """Distinct hashes of a lower-case word's runs of letters, of their first four and five letters, and of the groups of letters in them. Linear in the word."""
    import xxhash

    names = []
    for m in _RUN.finditer(word):
        run = m[0]
        names += [f"w{run}"] + [f"b{run[:n]}" for n in (4, 5) if len(run) > n]
        size = 2 if _UNSPACED.search(run) else 5
        names += [f"n{run[k : k + size]}" for k in range(len(run) - size + 1)]
    return [xxhash.xxh64_intdigest(x) >> 1 for x in dict.fromkeys(names)]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case words between white space: the distinct ones, each text's words as numbers of these, where each text's begin."""
    return numbered(pc.utf8_split_whitespace(pc.utf8_lower(texts)))


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' features in one array, and where each word's begin."""
    found = [features(w) for w in words]
    return np.array([f for x in found for f in x], np.int64), np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)


@dataclass
class OrdinalModel:
    """Weights by feature hash (zeros left out) and increasing thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> DataFrame:
    """(doc_id, toxic, features): distinct feature hashes of at most ``most`` labelled documents of each class."""
    truth = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    ranked = [truth.where(F.col("toxic") == c).orderBy(F.xxhash64("label_id"), "label_id").limit(most) for c in (0, 1)]
    chosen = ranked[0].union(ranked[1])
    # Two limits bound what is broadcast; a document repeated under one id counts once.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, part in by_size(batch.column(2)):
                words, number, begin = words_of(part)
                flat, at = features_of(words.to_pylist())
                found = [np.unique(np.concatenate([flat[at[w] : at[w + 1]] for w in np.unique(number[i:j])] or [flat[:0]])) for i, j in zip(begin, begin[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(part)), batch.column(1).slice(k, len(part)), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "toxic", "features"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, toxic int, features array<long>")


def telling_features(sample: DataFrame, most: int = MOST_FEATURES) -> list[int]:
    """The at most ``most`` features that favour toxic texts beyond chance, by counts that stay distributed."""
    n, bad = sample.agg(F.count(F.lit(1)), F.sum((F.col("toxic") > 0).cast("long"))).first()
    if not bad or bad == n:
        return []
    each = sample.select((F.col("toxic") > 0).cast("long").alias("bad"), F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    each = stored(each, "feature-counts")
    tried, share = each.count(), F.lit(bad / n)
    # How unlikely a feature's share of toxic texts is by chance: -log of Chernoff's bound, against all features tried.
    part = lambda x, of: x * F.log(F.greatest(x.cast("double"), F.lit(1e-12)) / F.greatest(of, F.lit(1e-12)))
    of, k = F.col("n"), F.col("k")
    chance = part(k, of * share) + part(of - k, of * (1 - share))
    told = each.where((chance > math.log(max(tried, 1)) + SCREEN) & (k > of * share)).orderBy(F.desc(F.round(chance, 6)), "feature").limit(most)
    return sorted(r.feature for r in told.select("feature").collect())


def fit(toxic: np.ndarray, rows: list[np.ndarray], rounds: int = 300, rate: float = 0.08, penalty: float = 2e-5) -> OrdinalModel:
    """Grade a sample by its ``rows`` of features, as far as these favour toxic texts, and fit the model by proximal descent with steps scaled to each gradient's size."""
    t = np.linspace(1.0, 3.0, GRADES - 1)
    if len(set(toxic.tolist())) < 2:
        return OrdinalModel({}, np.full(GRADES - 1, 30.0))
    names, col = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    told = np.bincount(col, (toxic > 0)[row], len(names)) > np.bincount(col, minlength=len(names)) * (toxic > 0).mean()
    names, col, row = names[told], (np.cumsum(told) - 1)[col[told[col]]], row[told[col]]
    bad = toxic > 0
    load = np.bincount(row, minlength=len(rows))
    cuts = np.quantile(load[bad], [1 / 3, 2 / 3])
    grade = np.where(bad, 1 + np.searchsorted(cuts, load, side="left"), 0)

    w, n = np.zeros(len(names)), len(rows)
    gw, gt = np.zeros(len(w)), np.zeros(len(t))
    for r in range(rounds):
        s = np.bincount(row, w[col], n)
        above = np.pad(1 / (1 + np.exp(np.clip(t - s[:, None], -60, 60))), ((0, 0), (1, 1)))
        above[:, 0] = 1
        a, b = above[np.arange(n), grade], above[np.arange(n), grade + 1]
        inside = np.maximum(a - b, 1e-9)
        dw = np.bincount(col, (a + b - 1)[row], len(names)) / n
        dt = (np.bincount(grade, a * (1 - a) / inside, GRADES)[1:] - np.bincount(grade, b * (1 - b) / inside, GRADES)[:-1]) / n
        gw, gt = 0.95 * gw + 0.05 * dw * dw, 0.95 * gt + 0.05 * dt * dt
        seen, now = 1 - 0.95 ** (r + 1), rate * (1 - r / rounds)
        w = np.maximum(w - now * (dw + penalty) / (np.sqrt(gw / seen) + 1e-6), 0)
        t = np.maximum.accumulate(t - now * dt / (np.sqrt(gt / seen) + 1e-6) + np.arange(GRADES - 1) * 1e-6)
    return OrdinalModel({int(k): float(x) for k, x in zip(names, w, strict=True) if x}, t)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> OrdinalModel:
    sample = stored(labelled_sample(docs, labels, most), "labelled")
    names = np.array(telling_features(sample), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(x.values.to_numpy(), names, assume_unique=True).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "toxic", "told"])

    # At most 2 x most rows, each with its telling features alone.
    rows = sample.mapInArrow(run, "doc_id long, toxic int, told binary").orderBy("doc_id", "toxic").collect()
    return fit(np.array([r.toxic for r in rows]), [np.frombuffer(r.told, np.int64) for r in rows])


def _scorer(model: OrdinalModel) -> Callable[[pa.Array], np.ndarray]:
    """w.x of each text: the weights of its distinct features, found through a task's memo of the words that have any."""
    of = model.weights

    def telling(words: pa.Array) -> pa.Array:
        return pa.array([[f for f in features(w) if f in of] for w in words.to_pylist()], pa.list_(pa.int64()))

    memo = PieceMemo(telling, pa.list_(pa.int64()))

    def scores(texts: pa.Array) -> np.ndarray:
        out = []
        for _, part in by_size(pc.fill_null(texts, "")):
            words, number, begin = words_of(part)
            found = memo.lookup(words)
            size = pc.list_value_length(found).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(part)), np.diff(begin))
            met = size[number] > 0
            pairs = np.unique(np.stack([text[met], number[met]], axis=1), axis=0)  # the few words of each text that tell
            flat = found.take(pa.array(pairs[:, 1])).flatten().to_numpy()
            names, feature = np.unique(flat, return_inverse=True)
            both = np.unique(np.stack([np.repeat(pairs[:, 0], size[pairs[:, 1]]), feature], axis=1), axis=0)
            weight = np.array([of[int(f)] for f in names], np.float64)
            out.append(np.bincount(both[:, 0], weight[both[:, 1]], len(part)))
        return np.concatenate(out) if out else np.zeros(0)

    return scores


def severity(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, rejected) for every document, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            above = model.above(scores(batch.column(1)))
            each = np.diff(np.pad(above, ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0))), axis=1) * -1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1).round(6)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0].round(6)), pa.array(above[:, 0] >= reject_at)], ["doc_id", "expected_severity", "grade", "p_toxic", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, rejected boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            above = model.above(scores(batch.column(at)))
            yield batch.filter(pa.array(above[:, 0] < reject_at))

    return docs.mapInArrow(run, docs.schema)
