"""Naive versions of what the two classifiers compute, step by step."""

import math
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeet.llm import quality, sampling, toxicity

TEXTS = ["", "one", "A b, c!! a", "wort " * 9 + "Das ist ein wort", "x1 y2\n| z |", "Ünï çødé ### ###"]


def naive_buckets(text):
    """The bucket numbers of words, by plain loops; a punctuation mark is a word."""
    spaced = "".join(f" {chr(c)} " if 33 <= c < 127 and not chr(c).isalnum() else chr(c) if c > 32 or c in (0, 1) else " " for c in text)
    return [crc32(w.encode("latin-1")) % quality.BUCKETS for w in spaced.split(" ") if w]


def test_buckets_are_words_and_marks():
    for text in [*TEXTS, "a.b,c!!d", "### x|y\t\r\n z"]:
        assert quality.buckets(text.encode()).tolist() == naive_buckets(text.encode())


@pytest.mark.parametrize("chunk", [3, 7, 50_000])
def test_context_sums_match_plain_loops_whatever_the_pieces(monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    pos, sign = quality.index_vectors()
    sums, want, seen = quality.Contexts(), {}, {}
    for text in TEXTS:
        sums.add(quality.buckets(text.encode()))
        ids = naive_buckets(text.encode())
        for i, x in enumerate(ids):
            seen[x] = seen.get(x, 0) + 1
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if i != j:
                    row = want.setdefault(x, [0] * quality.DIM)
                    for k in range(quality.NONZERO):
                        row[pos[ids[j], k]] += sign[ids[j], k]
    sums.sum_up()
    assert {int(b): int(sums.seen[b]) for b in np.flatnonzero(sums.seen)} == seen
    for b in seen:
        assert sums.total[b].tolist() == want.get(b, [0] * quality.DIM)


def test_word_vectors_come_from_all_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, None)]
    got = quality.word_vectors(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sums = quality.Contexts()
    for _, t in rows:
        sums.add(quality.buckets((t or "").encode()))
    sums.sum_up()
    assert np.allclose(got, quality.weighted(sums.total, sums.seen), atol=1e-6)


def test_pooling_is_the_same_in_chunks(monkeypatch):
    vectors = np.random.default_rng(2).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = [t.encode() for t in TEXTS]
    whole = quality.pool(texts, vectors)
    monkeypatch.setattr(quality, "CHUNK", 3)
    assert np.allclose(quality.pool(texts, vectors), whole, atol=1e-5)


def test_pooling_network_and_temperature_match_plain_loops():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    x = quality.pool([t.encode() for t in TEXTS], vectors)
    for row, text in zip(x, TEXTS):
        ids = naive_buckets(text.encode())
        mean = [sum(float(vectors[i][d]) for i in ids) / max(1, len(ids)) for d in range(quality.DIM)]
        square = [math.sqrt(sum(float(vectors[i][d]) ** 2 for i in ids) / max(1, len(ids))) for d in range(quality.DIM)]
        pairs = [sum(float(vectors[i][d] * vectors[j][d]) for i, j in zip(ids, ids[1:])) / max(1, len(ids) - 1) for d in range(quality.DIM)]
        assert np.allclose(row, [*mean, *square, *pairs], atol=1e-4)
    n, hidden = quality.WIDTH, 5
    layers = [rng.normal(size=(n, hidden)), rng.normal(size=hidden), rng.normal(size=hidden), rng.normal(size=1)]
    model = quality.QualityModel(vectors, rng.normal(size=n), rng.random(n) + 1, layers, 1.7, 0.5)
    for row, score in zip(x, model.score(x)):
        z = [(float(v) - m) / s for v, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(a * w for a, w in zip(z, layers[0][:, j])) + layers[1][j]) for j in range(hidden)]
        assert score == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(h, layers[2])) + layers[3][0]) / 1.7)), abs=1e-6)
    logits, y, w = rng.normal(size=80) * 4, (rng.random(80) < 0.5).astype(float), rng.random(80)
    best = quality.best_temperature(logits, y, w)
    loss = lambda t: sum(-a * math.log(1 / (1 + math.exp(-(v if k else -v) / t))) for v, k, a in zip(logits, y, w))
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.exp(np.linspace(np.log(0.25), np.log(8), 61)))


# ---- toxicity


def naive_features(text):
    words = set(text.translate(toxicity.WORD_TABLE).split())
    sets = [words] + [{w[:k] for w in words if len(w) >= k} for k in toxicity.ONCE]
    sets += [{w[:k] for w in words if sum(v[:k] == w[:k] and len(v) > k for v in words) >= 2 and len(w) > k} for k in toxicity.TWICE]
    return sorted(crc32(w) % toxicity.BUCKETS * toxicity.FAMILIES + f for f, found in enumerate(sets) for w in found)


def test_features_and_votes_match_plain_loops():
    texts = [t.encode() for t in TEXTS] + [b"vileword vileling vilest vileword", b"you are mean"]
    for text in texts:
        assert toxicity.features(text).tolist() == naive_features(text)
    best = [[] for _ in range(toxicity.FAMILIES)]
    for f in naive_features(texts[-2]):
        best[f % toxicity.FAMILIES].append(f)
    lexicons = toxicity.tiers(best)
    for text in texts:
        found = set(naive_features(text))
        want = [0] * toxicity.N_VOTERS
        for family, feats in enumerate(best):
            for rank, f in enumerate(feats):
                tier = next(t for t in range(len(toxicity.TIERS)) if rank < sum(toxicity.TIERS[: t + 1]))
                want[family * len(toxicity.TIERS) + tier] |= f in found
        want[toxicity.N_LEXICONS :] = toxicity.pattern_votes(text)
        assert lexicons.votes(toxicity.features(text), np.array(toxicity.pattern_votes(text))).tolist() == want


def made_votes(n=2500, rate=0.12, seed=2):
    """Votes of good, useless and echoing voters, and the labels behind them."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < rate).astype(float)
    votes = np.zeros((n, toxicity.N_VOTERS))
    for v in range(6):
        votes[:, v] = rng.random(n) < np.where(y > 0, 0.5, 0.004)
    votes[:, 6] = votes[:, 0]  # an echo
    votes[:, 7:9] = rng.random((n, 2)) < 0.3  # say nothing of the label
    return votes, y


def naive_em(votes, rate, known, rounds, better=12.0):
    """Expectation maximisation by loops over voters and rows."""
    n, m = votes.shape
    dev = [i for i in range(n) if known[i] >= 0]
    used = []
    for v in range(m):
        ones, zeros = [votes[i][v] for i in dev if known[i] == 1], [votes[i][v] for i in dev if known[i] == 0]
        on, off = (sum(ones) + 0.02) / (len(ones) + 1), (sum(zeros) + 0.5) / (len(zeros) + 4)
        used.append(on >= better * off and sum(ones) >= 3)
    full = [[v if u else 0.0 for v, u in zip(row, used)] for row in votes]
    full = [[*row, float(not any(row[: toxicity.N_LEXICONS]))] for row in full]
    q, weight = [max(0.0, float(k)) for k in known], [float(k >= 0) for k in known]
    for _ in range(rounds):
        on, off, rest = [], [], []
        for v in range(m + 1):
            w1, w0 = [w * a for w, a in zip(weight, q)], [w * (1 - a) for w, a in zip(weight, q)]
            on.append(min(1 - 1e-4, max(1e-4, (sum(w * r[v] for w, r in zip(w1, full)) + 0.02) / (sum(w1) + 1))))
            off.append(min(1 - 1e-4, max(1e-4, (sum(w * r[v] for w, r in zip(w0, full)) + 0.5) / (sum(w0) + 4))))
            rest.append([math.sqrt(w) * (r[v] - a * on[v] - (1 - a) * off[v]) for w, a, r in zip(weight, q, full)])
        size = [math.sqrt(sum(a * a for a in r)) + 1e-9 for r in rest]
        own = []
        for v in range(m + 1):
            agree = [sum(a * b for a, b in zip(rest[v], rest[u])) / (size[v] * size[u]) if u != v and m not in (u, v) else 0 for u in range(m + 1)]
            own.append(1 / (1 + sum(a for a in agree if a > 0.1)))
        q, weight = [], [max(1.0, (n - len(dev)) / len(dev)) if k >= 0 else 1.0 for k in known]
        for i in range(n):
            odds = math.log(rate / (1 - rate)) + sum(full[i][v] * own[v] * math.log(on[v] / off[v]) for v in range(m + 1))
            q.append(float(known[i]) if known[i] >= 0 else 1 / (1 + math.exp(-max(-30, min(30, odds)))))
    return used, on, off, own


def test_label_model_matches_plain_loops(monkeypatch):
    votes, y = made_votes(160, 0.3)
    votes = votes[:, [*range(9), toxicity.N_LEXICONS]]
    monkeypatch.setattr(toxicity, "N_LEXICONS", 9)
    known = np.where(np.arange(len(y)) < 60, y, -1).astype(int)
    model = toxicity.fit_label_model(votes, 0.3, known, rounds=4)
    used, on, off, own = naive_em(votes, 0.3, known, 4)
    assert model.used.tolist() == used
    for got, want in ((model.on, on), (model.off, off), (model.own, own)):
        assert np.allclose(got, want, atol=1e-9)


def test_label_model_trusts_good_voters_and_finds_labels_it_is_not_given():
    votes, y = made_votes()
    known = np.where(np.arange(len(y)) < 400, y, -1).astype(int)
    model = toxicity.fit_label_model(votes, 0.12, known)
    assert model.used[:7].all() and not model.used[7:9].any()
    assert model.own[0] < 0.8 and model.own[6] < 0.8 and model.own[1] > model.own[0]
    assert ((model.posterior(votes[400:]) > 0.3) == (y[400:] > 0.5)).mean() > 0.97


def test_classifier_learns_posteriors():
    rng = np.random.default_rng(4)
    has = rng.random((400, 20)) < 0.3
    q = np.where(has[:, 0] | has[:, 1], 0.95, 0.05)
    w, b = toxicity.train_linear(*np.nonzero(has), 20, q, np.ones(400))
    assert (((has @ w + b) > 0) == (q > 0.5)).mean() > 0.97 and min(w[0], w[1]) > max(w[2:])
    rows, cols = np.nonzero(has)
    model = toxicity.ToxicModel(np.arange(20) * 3, w, b)
    scores = model.score([cols[rows == i] * 3 for i in range(400)])
    assert np.allclose(scores, 1 / (1 + np.exp(-(has @ w + b))))


# ---- what is read off labelled rows


def labelled(spark, n=400):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [f"word{rng.integers(60)}" for _ in range(8)] + ([f"vile{rng.integers(4)}"] if toxic and rng.random() < 0.8 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic if rng.random() < 0.95 else None))
    rows += [(n, None), (None, "no id"), (7, "another text of 7")]
    labels += [(8, 0), (8, 1), (None, 1), (n, 0), (n + 5, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), rows, labels


def test_samples_are_bounded_and_weighted(spark):
    docs, labels, rows, given = labelled(spark)
    usable = sampling.fold_of(F.col("doc_id"), 4) != 2
    want = {}
    for i, v in given:
        if i is not None and v is not None and crc32(str(i).encode()) % 4 != 2:
            want[i] = max(v, want.get(i, 0))
    texts = {}
    for i, t in rows:
        texts[i] = min(t or "", texts.get(i, t or ""))
    everything, weights = sampling.labelled_sample(docs, labels, "toxic", usable, 10_000)
    assert {r["doc_id"]: (r["label"], r["text"]) for r in everything.collect()} == {i: (v, texts[i]) for i, v in want.items() if i in texts}
    assert weights == {0: 1.0, 1: 1.0}
    few, weights = sampling.labelled_sample(docs, labels, "toxic", usable, 30)
    got = [r["label"] for r in few.collect()]
    assert all(10 < got.count(k) < 60 and weights[k] == pytest.approx(sum(v == k for v in want.values()) / 30) for k in (0, 1))
    split = sampling.seeds_and_pool(docs, labels, "toxic", usable, seed_share=0.5, seeds=40, pool=50)
    parts = [(r["doc_id"], r["part"], r["label"]) for r in split.rows.collect()]
    assert len({i for i, _, _ in parts}) == len(parts) and all(want[i] == v if p != sampling.POOL else v is None for i, p, v in parts)
    assert 20 < sum(p == sampling.POOL for _, p, _ in parts) < 90 and 40 < sum(p != sampling.POOL for _, p, _ in parts) < 120
    assert split.counts == {k: sum(v == k for v in want.values()) for k in (0, 1)}


def test_lexicons_and_counts_match_plain_loops(spark):
    docs, labels, _, _ = labelled(spark)
    split = sampling.seeds_and_pool(docs, labels, "toxic", F.lit(True), seed_share=0.6, seeds=10_000, pool=10_000)
    rows = split.rows.mapInArrow(toxicity._extract, "doc_id long, part int, label int, feats array<int>, patterns binary")
    given = [(r["part"], r["label"], naive_features(r["text"].encode())) for r in split.rows.collect()]
    counted = {r["feature"]: (r["one"], r["all"], r["n"]) for r in toxicity._counted(rows, lambda label, feats, patterns: (0.25 * (label or 0), 0.5)).collect()}
    want = {}
    for _, label, feats in given:
        for f in feats:
            one, every, n = want.get(f, (0.0, 0.0, 0))
            want[f] = (one + 0.25 * (label or 0), every + 0.5, n + 1)
    assert counted == {f: (pytest.approx(a), pytest.approx(b), n) for f, (a, b, n) in want.items()}
    read = [(label, feats) for part, label, feats in given if part == sampling.READ]
    n_pos, n_neg = sum(v for v, _ in read), sum(1 - v for v, _ in read)
    best = [[] for _ in range(toxicity.FAMILIES)]
    for f in {f for _, feats in read for f in feats}:
        pos, neg = sum(v for v, feats in read if f in feats), sum(1 - v for v, feats in read if f in feats)
        a, b = (pos + 0.05) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
        if pos >= 2 and a > 4 * b:
            best[f % toxicity.FAMILIES].append((-round(math.log(a / b) * math.sqrt(pos), 9), f))
    lexicons = toxicity.tiers([[f for _, f in sorted(found)[: sum(toxicity.TIERS)]] for found in best])
    got = toxicity.read_lexicons(rows)
    assert got.feats.tolist() == lexicons.feats.tolist() and got.voters.tolist() == lexicons.voters.tolist() and len(got.feats) > 3


def test_held_out_rows_are_scored_well(spark):
    from waymeet.llm.queries import QUERIES

    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    for name, column, least in (("op2_quality_classifier", "quality", 0.97), ("op10_toxicity", "toxic", 0.95)):
        got = [(labels[r["doc_id"]][column], r["predicted"]) for r in QUERIES[name](spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
        assert len(got) > 500 and sum(a == b for a, b in got) / len(got) >= least
