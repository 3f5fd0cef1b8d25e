"""The pipeline's near-copy stage against brute force over all pairs."""

import itertools

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from trajframe.llm import near_copies

SF = "/root/testdata/sf0.01"


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def roots(ids, links):
    up = {k: k for k in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {top(k) for k in ids}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: sets_of(r.text) for r in docs.collect()}
    by_shingle = {}
    for d, x in sets.items():
        for s in x:
            by_shingle.setdefault(s, []).append(d)
    seen = {p for ds in by_shingle.values() if len(ds) < 2000 for p in itertools.combinations(sorted(ds), 2)}
    links = [(a, b) for a, b in seen if alike(sets[a], sets[b])]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    print("pairs:", len(links), "with different shingles:", sum(sets[a] != sets[b] for a, b in links), "kept:", len(kept), "of", len(sets))
    assert kept == roots(sets, links)


def test_recall_of_changed_words_and_chains(spark):
    g = np.random.default_rng(9)
    texts = {}
    for base in range(120):
        words = [f"b{base}w{k}" for k in range(160)]
        texts[len(texts)] = words
        for changes in (1, 2, 3, 4, 6):  # similarities on both sides of 0.8
            other = list(words)
            for k in g.choice(160, changes, replace=False):
                other[k] = f"x{len(texts)}y{k}"
            texts[len(texts)] = other
    chain = [f"c{k}" for k in range(300)]
    for k in range(10):
        texts[len(texts)] = chain[k * 10 : k * 10 + 150]
    texts |= {len(texts): [], len(texts) + 1: [], len(texts) + 2: ["one"]}
    sets = {d: sets_of(" ".join(x)) for d, x in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b])]
    docs = spark.createDataFrame([(d, " ".join(x) if x or d % 2 else None) for d, x in texts.items()], "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.drop_near_copies(docs).collect()}
    assert kept == roots(sets, links)
    assert near_copies.drop_near_copies(docs.where("false")).count() == 0


def test_large_group_on_both_sides_of_the_threshold(spark):
    """Copies of one text with changes of their own: exact groups, and few pairs are left to compare."""
    g = np.random.default_rng(4)
    base = [f"w{k}" for k in range(200)]
    texts = [base]
    for n in range(240):
        other = list(base)
        for k in g.choice(200, g.integers(1, 12), replace=False):
            other[k] = f"y{n}z{k}"
        texts.append(other[: 200 - int(g.integers(0, 30))])
    sets = {d: sets_of(" ".join(x)) for d, x in enumerate(texts)}
    pairs = list(itertools.combinations(sets, 2))
    want = {(a, b) for a, b in pairs if alike(sets[a], sets[b])}
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == roots(sets, want)
    # The pair search by itself: each text its own group.
    marks = near_copies.stored(near_copies.signatures(docs), "marks")
    live = marks.select("fp", F.col("fp").alias("label"))
    found = near_copies.sets_of(docs, marks.select("fp", F.col("doc_id").alias("first_doc")), live, "found")
    rows = near_copies.possible_pairs(near_copies.contested(found, live))
    of = {r.fp: r.doc_id for r in marks.collect()}
    tried = {tuple(sorted((of[r.a], of[r.b]))) for r in rows.collect()}
    assert want <= tried
    assert {tuple(sorted((of[r.a], of[r.b]))) for r in near_copies.verified(found, rows).collect()} == want
    print("pairs:", len(pairs), "alike:", len(want), "compared:", len(tried))
