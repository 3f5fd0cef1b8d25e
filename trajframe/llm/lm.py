"""Masked pseudo-likelihood scores from a small bidirectional window network.

Tokens are the pieces of a text between white space, known by 64-bit hashes, so the vocabulary grows with the corpus. A
network with one hidden layer predicts the class of every token (``CLASSES``, by hash) from the two tokens before and
the two after it, in two steps of a hierarchical softmax; within its class a token has its share of the corpus counts:
P(token | both sides) = P(class | both sides) x n(token) / n(class). The summed log-probabilities score a document.

One pass over all texts counts the tokens and trains the network in numpy, task by task over all of a task's windows;
Spark sums the tasks' counts and, parameter row by parameter row, their changes weighted by how many windows touched
them. Shares of frequent tokens (at most ``MOST_FREQUENT``) are broadcast, those of all others come by a join on the
hash: a token that is not frequent has few rows, so no key of that join is large.

Nulls: null and empty texts have no tokens, a sum of 0 and a null mean. An empty corpus trains nothing. Repeated rows and
ids are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import by_size, numbered, stored

SIDE, GROUPS, MEMBERS = 2, 32, 32
CLASSES = GROUPS * MEMBERS
#: Tokens whose shares are broadcast: 12 bytes each.
MOST_FREQUENT = 1_000_000
#: Tokens that a task counts before it hands the counts on and starts afresh.
MOST_COUNTED = 2_000_000
BATCH, RATE = 8192, 0.1
#: Rows of context embeddings that travel together.
CHUNK = 512


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, each text's tokens as numbers of these, and where each text's begin."""
    import xxhash

    pieces, number, begin = numbered(pc.ascii_split_whitespace(texts))
    pieces = [p for p in pieces.to_pylist()]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p) for p in pieces), np.uint64, len(pieces)).view(np.int64)
    # Splitting gives an empty piece for white space at an end.
    there = np.fromiter((p != "" for p in pieces), bool, len(pieces))[number] if len(pieces) else np.zeros(0, bool)
    return hashes, number[there], np.append(0, np.cumsum(there))[begin]


def class_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & (CLASSES - 1)).astype(np.int32)


def windows(classes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """For each place beside a token the class there, ``CLASSES`` beyond a text's ends."""
    at = np.arange(len(classes)) + SIDE * (1 + np.repeat(np.arange(len(begin) - 1), np.diff(begin)))
    x = np.full(len(classes) + SIDE * (len(begin) + 1), CLASSES, np.int32)
    x[at] = classes
    return [x[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))]


class WindowNetwork:
    """softmax over groups, then over a group's members, of tanh(sum of one embedding a place + b)."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        g = np.random.default_rng(seed)
        self.p = {
            "e": g.normal(0, 0.3, (2 * SIDE, CLASSES + 1, hidden)), "b": np.zeros((1, hidden)),
            "u": np.zeros((1, hidden + 1, GROUPS)), "v": np.zeros((GROUPS, hidden + 1, MEMBERS)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        np.exp(np.minimum(z, 60, out=z), out=z)
        z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
        return z

    def _forward(self, context: list[np.ndarray], target: np.ndarray) -> tuple:
        """Rows in order of their target's group: hidden layer, both softmaxes, and where each group's rows begin."""
        order = np.argsort(target.astype(np.int16), kind="stable")
        target, context = target[order], [c[order] for c in context]
        h = self.p["e"][0][context[0]]
        for k in range(1, 2 * SIDE):
            h += self.p["e"][k][context[k]]
        h += self.p["b"]
        np.tanh(h, out=h)
        h = np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)
        group, begin = target // MEMBERS, np.searchsorted(target, np.arange(GROUPS + 1) * MEMBERS)
        one = self._softmax(h @ self.p["u"][0])
        two = np.empty((len(h), MEMBERS), np.float32)
        for k in range(GROUPS):
            np.matmul(h[begin[k] : begin[k + 1]], self.p["v"][k], out=two[begin[k] : begin[k + 1]])
        return order, context, target, group, begin, h, one, self._softmax(two)

    def log_probability(self, context: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """Of each target class given the classes on both sides."""
        out = np.empty(len(target), np.float32)
        for at in range(0, len(target), BATCH):
            part = slice(at, at + BATCH)
            order, _, t, group, _, _, one, two = self._forward([c[part] for c in context], target[part])
            row = np.arange(len(t))
            out[part][order] = np.log(one[row, group] * two[row, t % MEMBERS] + 1e-12)
        return out

    def gradient(self, context: list[np.ndarray], target: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """The mean negative log-probability's gradient, and how many windows touch each row of parameters."""
        _, context, t, group, begin, h, one, two = self._forward(context, target)
        row, n = np.arange(len(t)), len(t)
        one[row, group] -= 1
        two[row, t % MEMBERS] -= 1
        g = {k: np.zeros_like(x) for k, x in self.p.items()}
        g["u"][0] = h.T @ one
        dh = one @ self.p["u"][0].T
        for k in range(GROUPS):
            some = slice(begin[k], begin[k + 1])
            g["v"][k] = h[some].T @ two[some]
            dh[some] += two[some] @ self.p["v"][k].T
        dh = dh[:, :-1] * (1 - h[:, :-1] ** 2)
        g["b"][0] = dh.sum(axis=0)
        touched = {"e": np.zeros(g["e"].shape[:2]), "b": np.full(1, n), "u": np.full(1, n), "v": np.diff(begin)}
        by_unit = np.ascontiguousarray(dh.T)
        for k, c in enumerate(context):
            for unit, x in enumerate(by_unit):
                g["e"][k][:, unit] = np.bincount(c, x, CLASSES + 1)
            touched["e"][k] = np.bincount(c, minlength=CLASSES + 1)
        return {k: x / n for k, x in g.items()}, touched

    def learn(self, context: list[np.ndarray], target: np.ndarray, squares: dict[str, np.ndarray], touched: dict[str, np.ndarray]) -> None:
        """Adagrad over all windows, in their order."""
        for at in range(0, len(target), BATCH):
            part = slice(at, at + BATCH)
            g, t = self.gradient([c[part] for c in context], target[part])
            for k, x in g.items():
                squares[k] += x * x
                self.p[k] -= RATE * x / (np.sqrt(squares[k]) + 1e-6)
                touched[k] += t[k]

    def rows(self) -> dict[str, np.ndarray]:
        """Parameters as rows: (rows, width) by name."""
        wide = {"e": 2 * SIDE * (CLASSES + 1), "b": 1, "u": 1, "v": GROUPS}
        return {k: x.reshape(wide[k], -1) for k, x in self.p.items()}


def count_and_learn(docs: DataFrame, network: WindowNetwork) -> DataFrame:
    """Rows (token, n) of a task's token counts, and rows (name, first, changed) of its changes to the network times how many windows touched them, followed by these numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WindowNetwork()
        own.p = {k: x.copy() for k, x in network.p.items()}
        squares = {k: np.zeros_like(x) for k, x in own.p.items()}
        touched = {k: np.zeros(x.shape[:2] if k == "e" else len(x)) for k, x in own.p.items()}
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            names, at = np.unique(np.concatenate([x[0] for x in waiting]), return_inverse=True)
            return names, np.bincount(at, np.concatenate([x[1] for x in waiting]), len(names)).astype(np.int64)

        def handed_on() -> Iterator[pa.RecordBatch]:
            names, n = merged()
            waiting.clear()
            for k in range(0, len(names), 100_000):
                some = names[k : k + 100_000]
                none = [pa.nulls(len(some), kind) for kind in (pa.string(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[k : k + 100_000]), *none], ["token", "n", "name", "first", "changed"])

        for batch in batches:
            for _, texts in by_size(batch.column(0)):
                hashes, number, begin = tokens_of(texts)
                if not len(number):
                    continue
                n = np.bincount(number, minlength=len(hashes))
                waiting.append((hashes[n > 0], n[n > 0]))
                if sum(len(x[0]) for x in waiting) > MOST_COUNTED:
                    waiting[:] = [merged()]
                    if len(waiting[0][0]) > MOST_COUNTED // 2:
                        yield from handed_on()
                classes = class_of(hashes)[number]
                own.learn(windows(classes, begin), classes, squares, touched)
        if waiting:
            yield from handed_on()
        before, after = network.rows(), own.rows()
        found = []
        for name, x in after.items():
            weight = touched[name].reshape(-1)
            change = np.concatenate([(x - before[name]) * weight[:, None], weight[:, None]], axis=1).astype("<f4")
            found += [(None, None, name, k, change[k : k + CHUNK].tobytes()) for k in range(0, len(x), CHUNK) if weight[k : k + CHUNK].any()]
        if found:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)], ["token", "n", "name", "first", "changed"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "token long, n long, name string, first int, changed binary")


def summed(changes: DataFrame, key: list[str]) -> DataFrame:
    """``changes`` added up by ``key``; rows are streamed, so memory doesn't grow with the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *name, changed in zip(*(batch.column(k).to_pylist() for k in (*key, "changed")), strict=True):
                x = np.frombuffer(changed, "<f4").astype(np.float64)
                total[tuple(name)] = total[tuple(name)] + x if tuple(name) in total else x
        for name, x in total.items():
            yield pa.RecordBatch.from_pylist([dict(zip(key, name, strict=True)) | {"changed": x.astype("<f4").tobytes()}], schema=pa.schema([(k, pa.string() if k == "name" else pa.int32()) for k in key] + [("changed", pa.binary())]))

    return changes.select(*key, "changed").repartition(*key).mapInArrow(run, ", ".join(f"{k} {'string' if k == 'name' else 'int'}" for k in key) + ", changed binary")


def train(docs: DataFrame) -> tuple[WindowNetwork, DataFrame]:
    """A network trained on all windows of all documents, and the corpus counts (token, n)."""
    network = WindowNetwork()
    found = stored(count_and_learn(docs, network), "learnt")
    counts = stored(found.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")), "vocabulary")
    changes = found.where("name is not null").withColumn("lot", F.pmod(F.xxhash64("changed"), F.lit(16)).cast("int"))
    rows = network.rows()
    for r in summed(summed(changes, ["name", "first", "lot"]), ["name", "first"]).collect():  # as many rows as the network has chunks
        of = rows[r.name]
        x = np.frombuffer(r.changed, "<f4").reshape(-1, of.shape[1] + 1)
        of[r.first : r.first + len(x)] += x[:, :-1] / np.maximum(x[:, -1:], 1)
    return network, counts


def frequent(counts: DataFrame, most: int = MOST_FREQUENT) -> int:
    """The least count that at most ``most`` tokens reach, from a histogram of counts on a logarithmic scale."""
    step = F.ceil(F.log2("n") * 8).cast("int")
    found = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("tokens"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()  # some hundred rows
    total, least = 0, 1 << 62
    for r in found:
        total += r.tokens
        if total > most:
            break
        least = r.n
    return least


def score(docs: DataFrame, network: WindowNetwork, counts: DataFrame, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, logp_sum, logp_mean) of every document; a token that ``counts`` lacks counts as met once."""
    least = frequent(counts, most_frequent)
    sizes = np.ones(CLASSES)
    for r in counts.groupBy(F.col("token").bitwiseAND(F.lit(CLASSES - 1)).cast("int").alias("k")).agg(F.sum("n").alias("n")).collect():  # a row a class
        sizes[r.k] = r.n
    top = counts.where(F.col("n") >= least).toArrow()  # at most most_frequent rows
    known, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(known)
    shared = docs.sparkSession.sparkContext.broadcast((network.p, known[order], np.log(n[order]).astype(np.float32), np.log(sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WindowNetwork()
        model.p, names, logs, of_class = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k, texts in by_size(batch.column(1)):
                hashes, number, begin = tokens_of(texts)
                text = np.repeat(np.arange(len(texts)), np.diff(begin))
                classes = class_of(hashes)
                place = np.minimum(np.searchsorted(names, hashes), max(len(names) - 1, 0))
                met = names[place] == hashes if len(names) else np.zeros(len(hashes), bool)
                share = (np.where(met, logs[place], 0) if len(names) else np.zeros(len(hashes))) - of_class[classes]
                each = model.log_probability(windows(classes[number], begin), classes[number]) + share[number]
                sums = np.bincount(text, each, len(texts))
                rare = ~met[number]
                pairs, times = np.unique(text[rare] * max(len(hashes), 1) + number[rare], return_counts=True)
                whose, which = pairs // max(len(hashes), 1), pairs % max(len(hashes), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(hashes[which]), pa.array(times, pa.int32())], ["token", "times"]))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(texts))), batch.column(0).slice(k, len(texts)), pa.array(np.diff(begin).astype(np.int64)), pa.array(sums), lists], ["row", "doc_id", "n_tokens", "sum", "rare"])
                row += len(texts)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(texts.mapInArrow(run, "row long, doc_id long, n_tokens long, sum double, rare array<struct<token:long,times:int>>"), "sums")
    each = rows.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.times")
    rest = each.join(counts.where(F.col("n") < least), "token").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    out = rows.drop("rare").join(rest, "row", "left").select("doc_id", "n_tokens", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("logp"))
    return out.select("doc_id", "n_tokens", F.round("logp", 3).alias("logp_sum"), F.round(F.try_divide("logp", "n_tokens"), 6).alias("logp_mean"))


def train_and_score(docs: DataFrame) -> DataFrame:
    return score(docs, *train(docs))
