"""The corpus operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from trajframe.llm import chat, decontaminate, huffman, lm, media, mixing, pii, queries, simhash, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, fp long, ids string"
ODD = [
    "",
    None,
    " ",
    "one",
    "two words",
    "  leading, trailing  \n\n x \n ",
    "tab\t two  spaces  nbsp 　 wide \x1c sep ▁mark ▁▁ x",
    "special <|endoftext|> inside <s> </s> <unk> <|im_end|>",
    "it's o'clock 123abc über-groß naïve ﬁ 漢字 \U0001f600 é",
    "a\x00b\r\nc",
    "word " * 3000,
    "x" * 20000,
    "9" * 5000 + "+" * 5000 + "@" * 50,
]


def frame(spark, texts, **over):
    rows = [(k, t, "en", over.get("source", lambda k: f"s{k % 3}")(k), 1, 2, 3, "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(real):
    return ODD + [r.text for r in real.select("text").orderBy("doc_id").collect()][:150]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = labels.where("pmod(xxhash64(doc_id), 4) > 0")
    out = by_id(toxicity.severity(docs, toxicity.train(docs, kept)))
    held = labels.where("pmod(xxhash64(doc_id), 4) = 0").collect()
    clean = [out[r.doc_id].rejected for r in held if not r.toxic]
    assert sum(clean) <= 0.03 * len(clean)
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = [out[r.doc_id].rejected for r in held if r.toxic and len(re.findall("idiot|moron|trash|clown|scum|worthless|pathetic|loser", texts[r.doc_id].lower())) >= 3]
    assert plain and sum(plain) >= 0.9 * len(plain)


def test_ordinal_model_orders_grades():
    rows = [np.array([1, 2])] * 60 + [np.array([2, 10])] * 20 + [np.array([2, 10, 11])] * 20 + [np.array([10, 11, 12])] * 20
    model = toxicity.fit(np.array([0] * 60 + [1] * 60), rows)
    assert list(model.thresholds) == sorted(model.thresholds)
    s = [model.above(np.array([sum(model.weights.get(int(f), 0) for f in r)]))[0].sum() for r in (rows[0], rows[60], rows[80], rows[100])]
    assert s[0] < s[1] < s[2] < s[3]


def test_toxicity_odd_rows(spark, docs, empty, texts):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (4, 0, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.severity(docs, model).count() == len(texts)
    none = toxicity.train(docs, labels.where("false"))
    assert toxicity.drop_toxic(docs, none).count() == len(texts)
    assert toxicity.drop_toxic(empty, model).columns == empty.columns
    assert toxicity.severity(empty, model).count() == 0


def test_toxicity_scores_equal_brute_force(spark):
    g = np.random.default_rng(5)
    words = ["idiot", "idiots", "IDIOT!", "fine", "day", "x" * 150, "idiotic" * 40, "a", "", "naïve", "clown,", "clowns"]
    texts = [None, "", " "] + [" ".join(g.choice(words, g.integers(0, 30))) for _ in range(200)]
    texts += texts[5:30]  # repeated rows and ties
    weights = {f: 0.3 + k % 5 for k, w in enumerate(["idiot", "clown", "x" * 150, "naïve"]) for f in toxicity.features(w)}
    model = toxicity.OrdinalModel(weights, np.array([1.0, 2.5, 4.0]))
    out = by_id(toxicity.severity(frame(spark, texts).repartition(3), model))
    for k, t in enumerate(texts):
        s = sum(weights.get(f, 0.0) for f in {f for w in (t or "").lower().split() for f in toxicity.features(w)})
        above = 1 / (1 + np.exp(np.clip(model.thresholds - s, -60, 60)))
        each = -np.diff([1, *above, 0])
        assert out[k].expected_severity == pytest.approx(above.sum(), abs=2e-6) and out[k].p_toxic == pytest.approx(above[0], abs=2e-6)
        assert out[k].grade == each.argmax() and out[k].rejected == (above[0] >= 0.5)


def test_toxicity_counts_features_in_spark(spark):
    docs = frame(spark, ["nasty words here"] * 8 + ["plain words here"] * 8 + [None, ""])
    labels = spark.createDataFrame([(k, 1, int(k < 8)) for k in range(18)], "doc_id long, quality int, toxic int")
    told = toxicity.telling_features(toxicity.labelled_sample(docs, labels))
    assert set(toxicity.features("nasty")) == set(told)
    assert len(toxicity.telling_features(toxicity.labelled_sample(docs, labels), 2)) == 2


def test_memo_is_bounded_and_right():
    from trajframe.llm.common import PieceMemo

    g, memo = np.random.default_rng(1), PieceMemo(lambda x: pa.array([len(v) for v in x.to_pylist()], pa.int64()), pa.int64(), 20_000)
    for _ in range(60):
        pieces = pa.array(sorted({"p" * int(n) for n in g.integers(0, 400, 60)}))
        assert memo.lookup(pieces).to_pylist() == [len(x) for x in pieces.to_pylist()]
        assert memo.keys.nbytes + memo.values.nbytes <= 20_000


@pytest.mark.parametrize("text", ["badword", "BADWORD!", "hello,badword", "x/badword", "xxbadword", "xxbadwordyy", "a\u0301-badword_9", "今天天气很好毒物今天", "毒物"])
def test_toxic_terms_are_seen_wherever_they_stand(spark, text):
    model = toxicity.OrdinalModel({f: 5.0 for term in ("badword", "毒物") for f in toxicity.features(term)}, np.array([1.0, 2.0, 3.0]))
    out = by_id(toxicity.severity(frame(spark, [f"so {text} there", "so nothing there, 今天天气很好"]), model))
    assert out[0].rejected and not out[1].rejected


@pytest.mark.parametrize("word", ["a" + "!" * 10**6 + "b", "ab" * 10**6, "9" * 10**6, "a1" * 10**6])
def test_words_of_any_length_are_linear(word):
    import time

    began = time.time()
    assert len(toxicity.features(word)) < 20
    assert time.time() - began < 8


@pytest.mark.parametrize("marks", ["!" * 100, "!" * 5000])
def test_toxicity_counts_long_words(spark, marks):
    model = toxicity.OrdinalModel({f: 5.0 for f in toxicity.features("idiot")}, np.array([1.0, 2.0, 3.0]))
    docs = frame(spark, ["you idiot", "you idiot" + marks, "you fine" + marks, "you " + "idiot" + "x" * 200])
    out = by_id(toxicity.severity(docs, model))
    assert out[0].rejected and out[1].p_toxic == out[0].p_toxic and not out[2].rejected
    assert out[3].rejected == (model.weights[toxicity.features("idiotx")[1]] > 1)
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {2}


def test_toxicity_held_out_with_one_or_two_terms(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = by_id(toxicity.severity(docs, toxicity.train(docs, labels.where("pmod(xxhash64(doc_id), 4) > 0"))))
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [r.doc_id for r in labels.where("pmod(xxhash64(doc_id), 4) = 0 and toxic = 1").collect()]
    few = [out[d].rejected for d in held if 1 <= len(re.findall("idiot|moron|trash|clown|scum|worthless|pathetic|loser", texts[d].lower())) <= 2]
    print("held-out toxic documents with one or two terms:", len(few), "rejected:", sum(few))
    assert not few or sum(few) >= 0.8 * len(few)


# 2


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>\\", None, "", "<|endoftext|>\n\n", "é <\\\\| \U0001f600", "plain"]
    rows = [(c, t, "assistant" if t % 2 else ("user" if c else "we\nird<|\\n"), tricky[(c + t) % 7], 9) for c in range(9) for t in range(c + 1)]
    rows += [(None, 0, None, "lost", 9), (3, None, "assistant", "first", 9), (4, 1, "assistant", tricky[5], 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.format_and_read_back(df).collect()}
    groups = defaultdict(list)
    for c, t, role, text, _ in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        plain = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        if c != 4:  # its repeated turn is ordered by ids
            assert got[c].turns_sha256 == hashlib.sha256(plain.encode()).hexdigest()
            assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(learned))
        whole = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n" for _, r, t in turns)
        assert got[c].formatted_chars == len(whole)
    assert chat.format_and_read_back(df.where("false")).count() == 0


def test_escape_is_reversible():
    for k in range(5):
        for x in itertools.product("<|\\a", repeat=k):
            t = "".join(x)
            assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
            assert chat.unescape_role(chat.escape_role(t + "\n")) == t + "\n"


# 3


def test_lm_windows_reach_over_both_sides():
    w = lm.windows(np.array([5, 6, 7, 8], np.int32), np.array([0, 1, 1, 4]))
    pad = lm.CLASSES
    assert [x.tolist() for x in w] == [[pad, pad, pad, 6], [pad, pad, 6, 7], [pad, 7, 8, pad], [pad, 8, pad, pad]]


def test_lm_gradient_is_the_slope():
    g = np.random.default_rng(0)
    context, target = [g.integers(0, lm.CLASSES + 1, 60) for _ in range(4)], g.integers(0, lm.CLASSES, 60).astype(np.int32)
    net = lm.WindowNetwork()
    net.p = {k: x.astype(np.float64) + g.normal(0, 0.1, x.shape) for k, x in net.p.items()}
    slope, touched = net.gradient(context, target)
    assert touched["e"].sum() == 240 and touched["v"].sum() == 60
    for k, at in (("e", (1, int(context[1][3]), 5)), ("b", (0, 2)), ("u", (0, 3, 4)), ("v", (int(target[0]) // 32, 7, int(target[0]) % 32))):
        loss = []
        for step in (1e-3, -1e-3):
            net.p[k][at] += step
            loss.append(-net.log_probability(context, target).mean(dtype=float))
            net.p[k][at] -= step
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(slope[k][at], rel=0.02, abs=2e-5)


def test_lm_counts_trains_and_scores_as_brute_force(docs, empty, texts):
    network, counts = lm.train(docs)
    split = [[w for w in re.split(r"[ \t-\r]+", t or "") if w] for t in texts]
    hash_of = lambda w: xxhash.xxh64_intdigest(w) - (1 << 64 if xxhash.xxh64_intdigest(w) >> 63 else 0)
    expected = Counter(hash_of(w) for x in split for w in x)
    assert {r.token: r.n for r in counts.collect()} == expected
    in_class = Counter()
    for h, n in expected.items():
        in_class[h % lm.CLASSES] += n
    p = {k: x.astype(float) for k, x in network.p.items()}

    def logp(words):
        classes = [hash_of(w) % lm.CLASSES for w in words]
        out = 0.0
        for k, w in enumerate(words):
            beside = [classes[j] if 0 <= j < len(classes) else lm.CLASSES for j in (k - 2, k - 1, k + 1, k + 2)]
            h = np.append(np.tanh(sum(p["e"][q][x] for q, x in enumerate(beside)) + p["b"][0]), 1)
            group, member = divmod(classes[k], lm.MEMBERS)
            for z, at in ((h @ p["u"][0], group), (h @ p["v"][group], member)):
                out += z[at] - np.log(np.exp(z).sum())
            out += np.log(expected[hash_of(w)] / in_class[classes[k]])
        return out

    for most in (lm.MOST_FREQUENT, 50):  # all shares broadcast; most of them joined
        out = by_id(lm.score(docs, network, counts, most))
        for k in (0, 1, 3, 6, 7, 14, 20, 30):
            assert out[k].n_tokens == len(split[k]) and out[k].logp_sum == pytest.approx(logp(split[k]), rel=1e-3, abs=0.05), k
            assert (out[k].logp_mean is None) == (not split[k])
    assert lm.train_and_score(empty).count() == 0


def test_lm_learns_and_tells_repeated_documents_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mean = lambda network, counts: lm.score(docs, network, counts).selectExpr("sum(logp_sum) / sum(n_tokens)").first()[0]
    network, counts = lm.train(docs)
    assert mean(network, counts) > mean(lm.WindowNetwork(), counts) + 0.3
    twice = docs.where("doc_id % 50 = 0 and length(text) > 400").withColumn("doc_id", docs.doc_id + 10_000_000)
    once, both = (by_id(lm.train_and_score(d)) for d in (docs, docs.union(twice)))
    ids = [r.doc_id - 10_000_000 for r in twice.collect()]
    gain = [both[k].logp_mean - once[k].logp_mean for k in ids]
    assert np.mean(np.array(gain) > 0) > 0.9


# 4


def test_token_counts(docs, empty, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = by_id(token_counts.count_tokens(docs, limit=100))
    for k, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (out[k].n_tokens, out[k].n_bytes, out[k].over_limit) == (n, len((t or "").encode()), n > 100), repr(t)[:80]
    assert token_counts.count_tokens(empty).count() == 0


def test_token_counts_of_random_spacing():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    g = np.random.default_rng(3)
    pool = [" ", " ", "\n", "▁", "a", "the", ",", "é", "漢", "\t", "1", "<s>"]
    many = ["".join(g.choice(pool, g.integers(0, 14))) for _ in range(4000)]
    assert token_counts.PieceLengths("piece_bpe_32k.model").count(many) == [len(x) for x in sp.encode(many)]


# 5


def test_media_round_trip(docs, empty, texts):
    out = by_id(media.store_and_read_back(docs))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        r = out[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert out[0].feature == out[1].feature
    assert media.store_and_read_back(empty).count() == 0


def test_media_malformed_and_clashing_columns(spark):
    good = media.encode_netpbm(np.arange(12, dtype=np.uint8).reshape(3, 4, 1))
    bad = [b"", b"BM", b"BM" + b"\0" * 60, b"P5\n4 4\n255\n12", b"P5\n0 4\n255\n", b"text"]
    df = spark.createDataFrame([(k, "mine", 7, bytearray(x)) for k, x in enumerate([good, *bad])] + [(9, None, 7, None)], "id int, npy string, height int, media binary")
    rows = {r.id: r for r in media.media_features(df).collect()}
    assert rows[0].height == 3 and rows[0].media_fault is None and bytes(rows[0].npy[:6]) == b"\x93NUMPY"
    for k, x in enumerate(bad, 1):
        assert rows[k].media_fault and rows[k].npy is None and rows[k].media_bytes == len(x)
    assert rows[9].media_fault is None and rows[9].media_bytes is None and len(rows[9]) == 11


def test_media_codecs_and_resize(spark):
    g = np.random.default_rng(0)
    for h, w in ((1, 1), (7, 5), (30, 41)):
        rgb = g.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert (media.decode(media.encode_bmp(rgb)) == rgb).all() and (media.decode(media.encode_netpbm(rgb)) == rgb).all()
        fine = np.kron(rgb.astype(float), np.ones((6, 6, 1)))  # 6x finer: any area mean is a plain mean there
        for to in ((3, 2), (2, 3)):
            if h * 6 % to[0] == 0 and w * 6 % to[1] == 0:
                blocks = fine.reshape(to[0], h * 6 // to[0], to[1], w * 6 // to[1], 3).mean(axis=(1, 3))
                assert media.area_resize(rgb, *to) == pytest.approx(blocks)
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(rgb))), (2, None)], "height_id int, media binary")
    a, b = media.media_features(df).orderBy("height_id").collect()
    assert (a.height, a.width, b.npy) == (30, 41, None) and bytes(a.npy[:6]) == b"\x93NUMPY"


# 6


def test_decontamination(spark, empty):
    item = [f"w{k}" for k in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short one"), (3, None), (1, " ".join(item)), (4, "a b c d e f g h i j k l")], "item_id long, text string")
    filler = [f"z{k}" for k in range(40)]
    swapped = [x if k % 9 else "other" for k, x in enumerate(item)]
    cases = {
        0: filler + item + filler,
        1: [x.upper() + "," for x in item],
        2: filler + swapped,
        3: filler,
        4: item[10:24],
        5: sorted(item * 2),
        6: None,
        7: [],
        8: list("abcdefghijkl") + filler + list("abcdefghijkl"),
        9: item[:7] + filler,
    }
    rows = [(k, None if x is None else " ".join(x), 1) for k, x in cases.items()] + [(0, " ".join(cases[0]), 1), (None, " ".join(item), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, bench).collect()}
    assert got.keys() == {(0, 1), (1, 1), (2, 1), (4, 1), (8, 4)}
    assert got[0, 1].n_equal == 30 and got[2, 1].n_equal == 26 and got[4, 1].n_equal == 14
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [3, 5, 6, 7, 9]
    assert decontaminate.overlaps(empty, bench).count() == 0 and decontaminate.overlaps(docs, bench.where("false")).count() == 0


def test_decontamination_equals_brute_force(spark, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    cut = lambda t: [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", t.lower()) if w]
    items, texts = {r.item_id: cut(r.text) for r in bench.collect()}, {r.doc_id: cut(r.text) for r in real.collect()}
    expected = set()
    for i, w in items.items():
        grams = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        expected |= {(d, i) for d, x in texts.items() if any(tuple(x[k : k + 8]) in grams for k in range(len(x) - 7))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(real, bench).collect()}
    assert expected <= got and expected
    for d, i in got:  # each is a real overlap along some shift
        x, w = texts[d], items[i]
        assert max(sum(0 <= s + k < len(x) and x[s + k] == w[k] for k in range(len(w))) for s in range(-len(w), len(x))) >= 9


def test_decontamination_masks_fit_between_all_substitutions():
    for n, masks in decontaminate.MASKS.items():
        most = n - -int(-n * decontaminate.SHARE // 1) if n >= decontaminate.EXACT_UNDER else 0
        assert (n - most) / n >= decontaminate.SHARE and (n < decontaminate.EXACT_UNDER or (n - most - 1) / n < decontaminate.SHARE)
        for other in itertools.combinations(range(n), most):
            assert any(not {s + o for o in m} & set(other) for m in masks for s in range(n - m[-1])), (n, other)


def test_decontamination_equals_brute_force_of_the_rule(spark):
    g = np.random.default_rng(3)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (1, 3, 7, 8, 9, 10, 11, 12, 13, 16, 20)}
    docs = {}
    for n, w in items.items():
        few = min(n, 13)
        for changes in range(5):
            for at in list(itertools.combinations(range(few), min(changes, few)))[:: 1 + changes * changes * 2]:
                x = [f"f{v}" for v in g.integers(0, 50, 6)] + [v if k not in at else "other" for k, v in enumerate(w[:few])] + ["tail"] * 5
                docs[len(docs)] = x
    def leaks(x, w):
        n = min(len(w), 13)
        need = n if n < 8 else 0.75 * n
        return any(sum(0 <= s + k < len(x) and x[s + k] == w[k] for k in range(a, a + n)) >= need for s in range(-len(w), len(x)) for a in range(len(w) - n + 1))
    expected = {(d, i) for d, x in docs.items() for i, w in items.items() if leaks(x, w)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    texts = spark.createDataFrame([(d, " ".join(x)) for d, x in docs.items()], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(texts, bench).collect()} == expected


# 7

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    card = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19]
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return {
        "email": [m.span() for m in re.finditer(EMAIL, text)],
        "ip": [m.span() for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in card if luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15],
    }


def test_pii_base_equals_patterns():
    g = np.random.default_rng(5)
    pool = ["a", "Z9", "@", ".", "-", "1", "255", "256", "+", " ", "(", ")", "@x.y", "1.2.3.4", "4111 1111 1111 1111", "é", "_%"]
    for _ in range(20000):
        t = "".join(g.choice(pool, g.integers(1, 12)))
        assert pii.identifiers(t) == plain(t), t


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail bob.smith (at) example (dot) com now", "email", "bob.smith (at) example (dot) com"),
        ("mail bob[at]example[dot]org.", "email", "bob[at]example[dot]org"),
        ("write to jane at mail dot example dot net today", "email", "jane at mail dot example dot net"),
        ("mail jоhn@ехample.com", "email", "jоhn@ехample.com"),
        ("host 192 dot 168 dot 1 dot 20 up", "ip", "192 dot 168 dot 1 dot 20"),
        ("call plus four nine one five one two three four five six", "phone", "plus four nine one five one two three four five six"),
        ("é " * 50 + "call ＋４９ 151 2345678", "phone", "＋４９ 151 2345678"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_pii_disguises_map_back(text, kind, source):
    base, added = pii.find(text)
    assert [text[a:b] for a, b in added[kind]] == [source]
    assert not base[kind] or all(text[a:b] not in source for a, b in base[kind]) or kind == "email"


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail john [at] example dot com now", "email", "john [at] example dot com"),
        ("mail john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("mail john dot smith (at) example.com now", "email", "john dot smith (at) example.com"),
        ("mail john at example (dot) co dot uk now", "email", "john at example (dot) co dot uk"),
        ("mail jоhn dot ann at ехample [dot] com now", "email", "jоhn dot ann at ехample [dot] com"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("host one nine two [dot] one six eight [dot] one dot one up", "ip", "one nine two [dot] one six eight [dot] one dot one"),
        ("host 192 dot one six eight dot 1 dot 20 up", "ip", "192 dot one six eight dot 1 dot 20"),
        ("call plus four nine dot one five one dot one two three dot four five", "phone", "plus four nine dot one five one dot one two three dot four five"),
    ],
)
def test_pii_mixed_disguises_map_back(text, kind, source):
    _, added = pii.find(text)
    assert [text[a:b] for a, b in added[kind]] == [source]


def test_pii_words_that_are_no_signs():
    for text in ("meet me at example.com", "the dot at the end dot", "one two three", " dot at dot com"):
        assert not any(pii.find(text)[1].values()), text


def test_pii_query(docs, empty, texts):
    out = by_id(pii.find_pii(docs))
    for k, t in enumerate(texts):
        if k == ODD.index(ODD[-1]):
            continue  # the plain pattern itself is quadratic on it
        base = plain(t or "")
        listed = ",".join(f"{x}:{a}:{b}" for x in pii.KINDS for a, b in base[x])
        assert out[k].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(out[k].spans.split(",")) and out[k].n_email == len(base["email"])
    assert pii.find_pii(empty).count() == 0


# 8


def test_huffman_files(spark, docs, texts, empty, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/out"
    huffman.write_token_files(docs, path, block_ids=3000)
    out = by_id(huffman.read_token_files(spark, path))
    at = 0
    for k, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (out[k].start, out[k].n_tokens, out[k].ids) == (at, len(ids), ids), repr(x)[:80]
        at += len(ids)
    digest = by_id(huffman.token_digests(spark, path))
    assert digest[7].ids_crc32 == zlib.crc32(np.array(out[7].ids, "<u4").tobytes())
    assert huffman.encode_and_read_back(empty).count() == 0
    assert huffman.encode_and_read_back(docs.limit(1)).count() == 1


def test_huffman_code_is_optimal_and_limited():
    g = np.random.default_rng(2)
    for n in (2, 3, 50, 4000):
        counts = np.ceil(g.pareto(0.6, n) * 5 + 1).astype(np.int64)
        free = huffman.code_lengths(counts, 60 if n < 100 else 16).astype(float)
        assert (0.5**free).sum() == pytest.approx(1)
        if n < 100:  # against the plain merge of the two least
            heap, cost = sorted(counts.tolist()), 0
            while len(heap) > 1:
                a, b = heap[:2]
                cost += a + b
                heap = sorted([a + b, *heap[2:]])
            assert (free * counts).sum() == cost
    steep = huffman.code_lengths(2 ** np.arange(40, dtype=np.int64), 16)
    assert steep.max() == 16 and (0.5 ** steep.astype(float)).sum() == pytest.approx(1)


def test_chunks_are_safe_for_random_spacing():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    g = np.random.default_rng(4)
    pool = [" ", " ", " ", "\n", "\t", " ", "a", "The", "'s", ",", ".", "é", "12", "<|endoftext|>", "漢", "%%%"]
    many = ["".join(g.choice(pool, g.integers(0, 14))) for _ in range(6000)]
    got = huffman.ByteBpe("byte_bpe_50k.json", pa.uint32()).encode(many)
    assert got.to_pylist() == [x.ids for x in t.encode_batch(many, add_special_tokens=False)]


def test_words_seen_before_need_no_library():
    bpe, sent = huffman.ByteBpe("byte_bpe_50k.json", pa.uint16()), []
    encode = bpe.words.encode
    bpe.words.encode = lambda words: (sent.append(len(words)), encode(words))[1]
    g = np.random.default_rng(5)
    words = np.unique(["".join(x) for x in g.choice(list("aeionrst"), (400_000, 7))])
    parts = np.array_split(words, 3)
    for x in parts:
        bpe.encode(pa.array([" ".join(x)]))
    before = sum(sent)
    assert before >= len(words) - len(parts)  # a text's first word goes another way
    for x in parts:
        text = ", ".join(x)
        assert bpe.encode(pa.array([text]))[0].as_py() == bpe.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(sent) - before <= len(parts) + 1  # those, and the comma


def test_library_starts_no_threads():
    code = """
import os, pyarrow as pa
from trajframe.llm import huffman
bpe = huffman.ByteBpe("byte_bpe_50k.json", pa.uint16())
before = len(os.listdir("/proc/self/task"))
bpe._library([f"word{k} and more" for k in range(2000)])
assert len(os.listdir("/proc/self/task")) == before, "threads"
"""
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=120)


# 9


def test_mixing_meets_weights(spark):
    sizes = {"big": 900, "mid": 90, "tiny": 12, None: 30}
    rows = [(k, "w " * (1 + k % 7), s) for s, n in sizes.items() for k in range(n)]
    rows += [(5, None, "big"), (6, "", "mid"), (5, "w " * 6, "mid"), (7, None, "void")]
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string, n int, block int")
    out = mixing.mix(docs, repetition=3.0).collect()
    own, mixed, seen = Counter(), Counter(), defaultdict(Counter)
    for _, t, s in rows:
        own[s] += len((t or "").split())
    for r in out:
        mixed[r.source] += len((r.text or "").split())
        seen[r.source][r.doc_id] += 1
    assert sum(map(len, seen.values())) == len(rows)  # every document appears
    t = 1 - np.log(3) / np.log(own["big"] / own["tiny"])
    for s in sizes:
        quota = own["big"] * (own[s] / own["big"]) ** t
        assert quota - 1 <= mixed[s] < quota + 8, s
        assert max(seen[s].values()) - min(seen[s].values()) <= 1
    assert mixed["tiny"] == pytest.approx(3 * own["tiny"], abs=8)
    assert set(docs.columns) <= set(mixing.mix(docs).columns)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_keeps_clashing_columns_and_repeated_rows(spark):
    names = ("mix_source", "mix_passes", "mix_n_blocks", "mix_cut_block", "mix_at", "at", "passes", "doc", "n", "weight", "block", "order", "range")
    docs = spark.createDataFrame([(k % 40 if k % 11 else None, "a b c" if k % 7 else None, "x" if k % 10 else None, *[7] * len(names)) for k in range(200)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_weight", "mix_epoch", "mix_block", "mix_order"]
    rows = out.collect()
    assert all(r[n] == 7 for r in rows for n in names)
    first = Counter((r.doc_id, r.text, r.source) for r in rows if r.mix_epoch == 0)
    assert first == Counter((r.doc_id, r.text, r.source) for r in docs.collect())


def test_mixing_partial_pass_is_a_prefix_of_the_permutation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    docs = spark.createDataFrame([(k, "w " * (1 + k % 5), "x" if k < 900 else "y") for k in range(1200)], "doc_id long, text string, source string")
    out = [r for r in mixing.mix(docs, repetition=1.6).collect() if r.source == "y"]
    again = {r.doc_id for r in out if r.mix_epoch == 1}
    from pyspark.sql import functions as F

    rows = docs.where("source = 'y'").withColumn("at", mixing._block(F.lit(75))).select("doc_id", "text", mixing._block_order(F.lit(1), "at").alias("b"), mixing._doc_order(F.lit(1)).alias("d")).collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.b, r.d))]
    assert 0 < len(again) < 300 and set(order[: len(again)]) == again


def test_mixing_entropy_and_budget(spark):
    docs = spark.createDataFrame([(k, "a b c", "x" if k % 10 else "y") for k in range(1000)], "doc_id long, text string, source string")
    totals = mixing.source_totals(docs)
    t = mixing.find_exponent(totals, entropy=0.6)
    w = np.array([0.9, 0.1]) ** t
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.6, abs=1e-6)
    out = Counter(r.source for r in mixing.mix(docs, entropy=0.6, budget=300).collect())
    assert out["x"] * 3 == pytest.approx(300 * w[0], abs=3) and out["y"] * 3 == pytest.approx(300 * w[1], abs=3)


def test_mixing_cut_is_inside_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 10)
    docs = spark.createDataFrame([(k, "a b", "x" if k < 300 else "y") for k in range(420)], "doc_id long, text string, source string")
    out = mixing.mix(docs, repetition=1.7).collect()
    assert sum(r.source == "y" for r in out) == 204
    last = {r.mix_block for r in out if r.source == "y" and r.mix_epoch == 1}
    assert 7 <= len(last) <= 12


# 10


def brute_force_groups(texts):
    fps = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min(group[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == group:
            break
        group = new
    return fps, group


def test_simhash_groups(spark, texts, empty):
    near = [" ".join(w if k != 40 + d else "changed" for k, w in enumerate(texts[20].split())) for d in range(12)]
    all_texts = [*texts, *near, *texts[14:40], "Mixed CASE Words Here", "mixed case words here", "Über x y", "über x y"]
    fps, group = brute_force_groups(all_texts)
    got = by_id(simhash.near_duplicate_groups(frame(spark, all_texts).repartition(3)))
    for k in range(len(all_texts)):
        assert got[k].fingerprint == f"{fps[k]:016x}", k
        assert got[k].component_id == group[k], k
    kept = simhash.drop_near_duplicates(frame(spark, all_texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group)) and kept.columns == empty.columns
    assert simhash.near_duplicate_groups(empty).count() == 0


def test_simhash_odd_ids_and_columns(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (2, "one two three four"), (None, "one two three four"), (None, None), (3, None), (4, ""), (1, "nothing alike here at all")]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, kept_doc_id long, component_id int")
    out = simhash.near_duplicate_groups(docs)
    assert out.count() == len(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(-1, ""), (-1, "one two three four"), (1, "nothing alike here at all"), (1, "one two three four"), (3, "")])


def test_simhash_splits_hot_halves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 3)
    test_simhash_links_every_distance_up_to_three(spark)


def test_simhash_links_every_distance_up_to_three(spark):
    g = np.random.default_rng(8)
    base = [int(x) for x in g.integers(0, 2**63, 40)]
    fps = set(base)
    for x in base:
        for d in (1, 2, 3, 4):
            fps.add(x ^ sum(1 << int(b) for b in g.choice(64, d, replace=False)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    labels = simhash.smallest_reachable(nodes, simhash.star_links(nodes))
    merged = {r.fp: r.label for r in simhash.smallest_reachable(labels.selectExpr("label as fp").distinct(), simhash.cross_links(labels)).collect()}
    of = {r.fp: merged[r.label] for r in labels.collect()}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            assert of[a] == of[b]
    assert len(set(of.values())) >= 40


def test_chain_components(spark):
    n = 200
    links = spark.createDataFrame([(k, k + 1) for k in range(0, n) if k % 50 != 49], "a long, b long")
    got = simhash.smallest_reachable(spark.range(n).selectExpr("id as fp"), links).collect()
    assert all(r.label == r.fp // 50 * 50 for r in got)


# queries


def test_every_query_has_its_contract_columns(spark):
    got = queries.queries()
    assert len(got) == 10 and {re.match(r"op(\d+)_", k)[1] for k in got} == {str(k) for k in range(1, 11)}
    expected = {
        "op4": "doc_id n_bytes n_tokens over_limit",
        "op5": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op8": "doc_id start n_tokens ids_crc32",
        "op10": "doc_id fingerprint component_id",
    }
    for name, f in got.items():
        if name.split("_")[0] in expected:
            df = f(spark, SF)
            assert set(expected[name.split("_")[0]].split()) <= set(df.columns) and df.count() == 200
