"""Line dedup, vector codes and the filter audit against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trajframe.llm import filter_audit, line_dedup, vector_codes

SPACES = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Columns that have the names the operators use inside.
LINE_DOCS = "doc_id long, text string, doc long, text_key long, keep string, at int, row int, h1 long, first long, part int, known boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3, 4, 5, 6, 7, True) for i, t in rows], LINE_DOCS)


def key_of(line):
    return line.strip(SPACES).translate(UPPER)


def expected_lines(rows, least=10):
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(k := key_of(line)) >= least:
                first[k] = min(first.get(k, (True, math.inf)), rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [len(k := key_of(x)) < least or first[k] == rank(i) for x in lines]
        kept = "\n".join(itertools.compress(lines, keep))
        out.append((i, len(lines), len(lines) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def random_docs(n=160, seed=3):
    g = np.random.default_rng(seed)
    lines = ["a common line of text", "A Common LINE of text  ", "\ta common line of text\r", "short", "", " ", "exactly 10", "nine char", "Éclair über alles", "éclair über alles", "ÉCLAIR ÜBER ALLES", "x" * 3000, "漢字漢字漢字漢字漢字", "0123456789\x1c", "0123456789"]
    lines += [f"line number {k}" for k in range(40)]
    rows = [(int(k), "\n".join(g.choice(lines, int(g.integers(0, 9))))) for k in g.permutation(n)]
    rows += [(3, None), (None, "a common line of text\nonly among nulls"), (None, "only among nulls\nonly among nulls"), (n + 1, "\n\n"), (n + 2, "a common line of text\n" * 500)]
    return rows + rows[:4]  # repeated rows


def line_results(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_line_dedup_equals_brute_force(spark):
    rows = random_docs()
    docs = frame(spark, rows).repartition(5)
    assert line_results(line_dedup.line_digests(docs)) == Counter(x[:4] for x in expected_lines(rows))
    left = line_dedup.drop_repeated_lines(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter((x[0], x[4]) for x in expected_lines(rows))


def test_line_dedup_frequent_keys(spark):
    """A line in most documents is broadcast with its first document and spread; results stay."""
    rows = [(k, f"the very common line\nown line number {k}\nTHE VERY common line") for k in range(600)]
    docs = frame(spark, rows).repartition(4)
    hot = line_dedup.frequent_firsts(docs, 4).collect()
    assert [r["first"] for r in hot] == [0]
    assert line_results(line_dedup.line_digests(docs)) == Counter(x[:4] for x in expected_lines(rows))


def test_line_bitmaps_are_compressed(spark):
    rows = [(1, "a line that repeats"), (2, "\n".join(f"unique line {k}" for k in range(1000)) + "\na line that repeats")]
    got = line_dedup.keep_bitmaps(frame(spark, rows)).collect()
    assert [(r.doc, [tuple(w) for w in r.keep]) for r in got] == [(2, [(1000 // 32, 0xFFFFFFFF ^ 1 << 1000 % 32)])]


def test_line_dedup_empty(spark):
    empty = frame(spark, [(1, "x")]).where("false")
    assert line_dedup.line_digests(empty).count() == 0 and line_dedup.drop_repeated_lines(empty).columns == empty.columns
    only = line_dedup.line_digests(frame(spark, [(None, None), (5, "")])).collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in only} == {(None, 1, 0), (5, 1, 0)}


def test_line_dedup_stays_in_the_engine(spark):
    plan = line_dedup.line_digests(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# 12

VECTORS = "vec_id long, embedding array<float>, label int, n int, parts string, orders int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "p", 2) for i, v, lab in rows], VECTORS)


def brute_codes(rows, rounds=4):
    kept = sorted(((i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // 4
    cut = [[r[1][p * w : p * w + w] for r in kept] for p in range(4)]
    books = [list(c[:256]) for c in cut]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (gap(v, books[p][e]), e)) for v in cut[p]] for p in range(4)]
    for _ in range(rounds):
        got = near()
        for p in range(4):
            own = defaultdict(list)
            for v, e in zip(cut[p], got[p], strict=True):
                own[e].append(v)
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    got = near()
    out, by = [], Counter()
    for k, (i, _, lab) in enumerate(kept):
        error = sum(gap(cut[p][k], books[p][got[p][k]]) for p in range(4))
        by[lab] += error
        out.append((i, lab, "".join(f"{got[p][k]:02x}" for p in range(4)), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, by[lab], digest) for i, lab, code, error in out)


@pytest.mark.parametrize("n,scale", [(700, 0.01), (300, 1.0), (40, 1.0)])
def test_vector_codes_equal_brute_force(spark, n, scale):
    """Small scales give many equal parts and ties; 40 rows give fewer entries than 256."""
    g = np.random.default_rng(n)
    rows = [(int(k), [float(np.float32(x)) for x in g.normal(0, scale, 8)], [None, 1, 2][int(k) % 3]) for k in g.permutation(n)]
    rows += [(n + 1, None, 1), (n + 2, [1.0, None] * 4, 1), (n + 3, [float("nan")] * 8, 1), (n + 4, [float("inf")] + [0.0] * 7, None), (n + 5, [], 1), (n + 6, [1.0] * 12, 1), (None, [0.5] * 8, None)]
    rows += rows[:5]
    got = vector_codes.code_report(vectors(spark, rows).repartition(3))
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == brute_codes(rows)


def test_vector_codes_of_huge_components(spark):
    g = np.random.default_rng(1)
    rows = [(k, [float(np.float32(x)) for x in g.normal(0, 1, 4) * 10.0 ** g.integers(0, 20)], k % 2) for k in range(60)]
    got = vector_codes.code_report(vectors(spark, rows)).collect()
    want = brute_codes(rows)
    fit = lambda x: x if x is None or x < 1 << 63 else None
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == Counter((a, b, fit(c), fit(d)) for a, b, c, d, _ in want)
    assert {r.codebooks_sha256 for r in got} == {x[4] for x in want}


def test_vector_codes_without_rows(spark):
    none = vectors(spark, [(1, None, 1), (2, [1.0, 2.0], 1)])
    assert vector_codes.code_report(none).count() == 0 and vector_codes.code_report(none.where("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_dual_tree_prunes_and_is_exact():
    g = np.random.default_rng(7)
    centres = g.integers(-5000, 5000, (16, 4))
    points = centres[np.sort(g.integers(0, 16, 4096))] + g.integers(-20, 20, (4096, 4))
    book = np.concatenate([centres, centres + 3])
    order = vector_codes.tree_order(points, vector_codes.LEAF)
    tree = vector_codes.Tree(points[order], vector_codes.LEAF)
    entries, index = vector_codes._entry_tree(book)
    codes, whole = vector_codes.assign(tree, entries, index)
    d = ((tree.points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (codes == d.argmin(axis=1)).all()
    far = vector_codes._entry_tree(centres)
    codes, whole = vector_codes.assign(tree, *far)
    d = ((tree.points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (codes == d.argmin(axis=1)).all() and whole
    covered = sum(tree.at[level][node + 1] - tree.at[level][node] for level, node, _ in whole)
    assert covered >= 0.9 * len(points)  # most parts are assigned by their nodes' cached sums
    for level, node, _ in whole:
        assert (tree.total[level][node] == tree.points[tree.at[level][node] : tree.at[level][node + 1]].sum(axis=0)).all()


# 13

AUDIT_DOCS = "doc_id long, text string, source string, mask int, h1 long, first long, part string, good int, labelled long"


def brute_audit(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        words = word.findall(t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts[s or ""].append(({f for f in fails if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    rows, shapley = [], Counter()
    for part, own in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here, stay = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                shapley[part, f] += len(here)
                rows.append((part, "".join(order), step, len(stay), len(here), sum(f in d[0] for d in own) - len(here), sum(d[0] == {f} for d in own), sum(d[1] for d in here), sum(d[2] for d in here), f))
                left = stay
    return {(*r[:9], shapley[r[0], r[9]]) for r in rows}


def audit_docs():
    g = np.random.default_rng(11)
    words = ["word", "Word", "SHOUT", "naïve", "a#b", "c", "\x1c", "\xa0", "x" * 50] + [f"w{k}" for k in range(60)]
    docs = []
    for k in range(240):
        pick = words if k % 3 else words[9:]
        docs.append((k, " \t\n"[k % 3].join(g.choice(pick, int(g.choice([0, 3, 49, 50, 51, 80, 200])), replace=True)), ["s1", "s2", None, ""][k % 4]))
    docs += [(300 + k, docs[k % 7][1], "s1") for k in range(40)] + [(400, None, "s2"), (401, None, None), (None, docs[0][1], "s1"), (None, None, "s1"), (5, docs[5][1], "s1"), (402, "", "s3"), (403, "Long " * 400_000, "s2"), (404, "A" + "b" * 19, "s2"), (405, "A" + "b" * 18, "s2")]
    return docs


def test_filter_audit_equals_brute_force(spark):
    docs = audit_docs()
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 420, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (7, None, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2, 3, "p", 1, 9) for d in docs], AUDIT_DOCS).repartition(4)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * len({d[2] or "" for d in docs})
    assert {tuple(r) for r in got} == brute_audit(docs, labels)


def test_filter_audit_without_rows_or_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame([(*d, 1, 2, 3, "p", 1, 9) for d in audit_docs()[:20]], AUDIT_DOCS)
    assert filter_audit.audit(frame.where("false"), labels).count() == 0
    assert {tuple(r) for r in filter_audit.audit(frame, labels).collect()} == brute_audit(audit_docs()[:20], [])


def test_long_texts_are_walked():
    text = ("Ab é#\t" * 300_000).encode()
    assert len(text) > filter_audit.LONG and filter_audit.mask_of(text) == filter_audit.mask_of(text[:7000])


def test_removal_intervals_cover_each_order_once():
    seen = Counter()
    for mask, step, letter, begin, end in filter_audit.removal_intervals():
        for rank in range(begin, end):
            assert filter_audit.ORDERS[rank][step] == "ABCDE"[letter] and mask >> letter & 1
            seen[mask, rank] += 1
    assert len(seen) == 31 * 120 and set(seen.values()) == {1}
