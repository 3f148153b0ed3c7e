"""Toxicity by weak supervision.

Many voters look at a document: lexicons of words and of word beginnings, and patterns of shouting, repetition and
address. The lexicons are read off a small seed of labelled documents, in tiers of falling evidence, in several
languages at once because nothing is assumed about any. A voter that finds nothing abstains; one more voter speaks for
"clean" where every lexicon abstains. A generative label model then looks at documents whose labels it is not given and
estimates by expectation maximisation how often each voter speaks in toxic and in clean ones, and which voters agree
beyond that, so that echoes of one another count less. Its posterior labels, and nothing else, train a linear
classifier over hashed words, which scores the whole corpus; only the classifier is needed then.

What reaches the driver is bounded whatever the texts: the best features, a byte for each voter and a bit for each
chosen feature of a sampled row.

Defined results: a null or empty text has no features and gets the classifier's base score; repeated rows get the same
score each; other columns, whatever their names, are ignored; of documents with one doc_id the smallest text is fitted
on; without labels of both classes the score is the labels' smoothed rate, 0.5 without any; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import corpus, discard, store, text_key, tune
from .sampling import DEVELOP, READ, Split, seeds_and_pool

_byte = np.arange(256, dtype=np.uint8)
_upper = (_byte >= 65) & (_byte <= 90)
_lower = (_byte >= 97) & (_byte <= 122)
_digit = (_byte >= 48) & (_byte <= 57)
_high = _byte >= 128
_white = np.isin(_byte, np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8))
#: Bytes as they count in words (lower case, else a space), and their kinds.
WORD_TABLE = np.where(_upper, _byte + 32, np.where(_lower | _digit | _high, _byte, 32)).astype(np.uint8).tobytes()
SHAPE_TABLE = np.where(_upper, 65, np.where(_lower | _high, 97, np.where(_digit, 48, np.where(_white, 32, _byte)))).astype(np.uint8).tobytes()

BUCKETS = 1 << 20
ONCE = (4, 5)  # bytes of a word's beginning
TWICE = (4, 5, 6, 7)  # of beginnings that at least two different words share
FAMILIES = 1 + len(ONCE) + len(TWICE)
#: Features in each lexicon of a family, the strongest first. This, LEAST_OFF and `better` were chosen by labelled rows of
#: sf0.1 whose remainder is 3, after fitting on those whose remainder is 0 or 1; README has the figures.
TIERS = (4,) * 6
#: How far a feature's rows must be from the mean posterior, in squared standard deviations, for the classifier to use it.
LEAST_OFF = 5.0
N_LEXICONS = FAMILIES * len(TIERS)

#: Address and threat frames, as words of any case (fixed values).
FRAMES = (b"you are", b"you re", b"shut up", b"go away", b"du bist", b"tu es", b"eres un", b"hate you", b"kill")
PATTERNS = ("shouting", "exclamation", "repetition", "frames", "symbols")
N_VOTERS = N_LEXICONS + len(PATTERNS)


def features(text: bytes) -> np.ndarray:
    """Distinct feature numbers of a text: its words and their beginnings; the family is the number modulo FAMILIES."""
    words = set(text.translate(WORD_TABLE).split())
    found: list[set[bytes]] = [words, *({w[:size] for w in words if len(w) >= size} for size in ONCE)]
    for size in TWICE:
        once: set[bytes] = set()
        found.append({h for w in words if len(w) > size and ((h := w[:size]) in once or once.add(h))})
    return np.unique(np.concatenate([np.fromiter(map(crc32, f), np.int64, len(f)) % BUCKETS * FAMILIES + k for k, f in enumerate(found)]))


def pattern_votes(text: bytes) -> list[int]:
    """1 where a pattern is found."""
    shapes = text.translate(SHAPE_TABLE)
    words = text.translate(WORD_TABLE).split()
    n, letters = max(1, len(words)), max(1, len(text))
    line = b" " + b" ".join(words) + b" " if len(words) else b""
    return [
        int(shapes.count(b"A") > 0.3 * letters),
        int(text.count(b"!!") > 0.02 * n),
        int(len(set(words)) < 0.3 * n),
        int(any(b" " + f + b" " in line for f in FRAMES)),
        int(sum(text.count(c) for c in (b"@", b"#", b"$", b"%", b"*")) > 0.05 * letters),
    ]


@dataclass
class Lexicons:
    """Sorted features and the voter that each belongs to."""

    feats: np.ndarray
    voters: np.ndarray

    def votes(self, feats: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        """What the lexicons and patterns say of a text: 1 for toxic, 0 to abstain."""
        out = np.zeros(N_VOTERS, np.uint8)
        if len(self.feats) and len(feats):
            at = np.minimum(np.searchsorted(self.feats, feats), len(self.feats) - 1)
            out[self.voters[at[self.feats[at] == feats]]] = 1
        out[N_LEXICONS:] = patterns
        return out


def tiers(best: list[list[int]]) -> Lexicons:
    """Lexicons of the features of each family, given strongest first."""
    feats, voters = [], []
    for family, found in enumerate(best):
        feats += found
        voters += [family * len(TIERS) + t for t in np.repeat(np.arange(len(TIERS)), TIERS)[: len(found)]]
    order = np.argsort(np.array(feats, np.int64), kind="stable")
    return Lexicons(np.array(feats, np.int64)[order], np.array(voters, np.int64)[order])


@dataclass
class LabelModel:
    """How often each voter speaks given the hidden label, and how much of its word is its own.

    Voters that abstain say nothing. The last voter is for "clean" and speaks where all lexicons in use abstain.
    """

    prior: float
    used: np.ndarray  # which voters are better than chance
    on: np.ndarray  # given toxic
    off: np.ndarray  # given clean
    own: np.ndarray  # weight after agreement with other voters

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        return np.log(self.prior / (1 - self.prior)) + with_silence(votes, self.used) @ (np.log(self.on / self.off) * self.own)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -30, 30)))


def with_silence(votes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The votes of voters in use, and one more that speaks where no lexicon of them does."""
    votes = votes * used
    return np.concatenate([votes, ~votes[:, :N_LEXICONS].any(axis=1, keepdims=True)], axis=1)


def rates(votes: np.ndarray, q: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each voter speaks where the label is 1, and where it is 0, for posterior labels q."""
    on = ((weight * q) @ votes + 0.02) / ((weight * q).sum() + 1)
    off = ((weight * (1 - q)) @ votes + 0.5) / ((weight * (1 - q)).sum() + 4)
    return np.clip(on, 1e-4, 1 - 1e-4), np.clip(off, 1e-4, 1 - 1e-4)


def echoes(votes: np.ndarray, q: np.ndarray, weight: np.ndarray, on: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Correlations of voters given the label, where above 0.1; silence, the last one, has none."""
    rest = (votes - np.outer(q, on) - np.outer(1 - q, off)) * np.sqrt(weight)[:, None]
    size = np.sqrt((rest * rest).sum(axis=0)) + 1e-9
    agree = (rest.T @ rest) / np.outer(size, size)
    agree[-1, :] = agree[:, -1] = 0
    np.fill_diagonal(agree, 0)
    return np.where(agree > 0.1, agree, 0)


def fit_label_model(votes: np.ndarray, rate: float, known: np.ndarray, rounds: int = 40, better: float = 12.0) -> LabelModel:
    """Expectation maximisation over votes. known: 1 or 0 where the label is given, -1 where it is not.

    rate, the share of label 1, stays the prior. Voters that speak less than `better` times as often in toxic as in
    clean documents of given label, or in fewer than three toxic ones, are not used. The search starts from those
    documents, which weigh as much as all others together, so that it can't run away; in every round voters are
    discounted by their correlations.
    """
    given = known >= 0
    on, off = rates(votes[given], known[given].astype(float), np.ones(int(given.sum())))
    used = (on >= better * off) & (known[given] @ votes[given] >= 3)
    full = with_silence(votes, used)
    q, weight = np.where(given, known, 0.0), given.astype(float)
    for _ in range(rounds):
        on, off = rates(full, q, weight)
        own = 1 / (1 + echoes(full, q, weight, on, off).sum(axis=1))
        model = LabelModel(rate, used, on, off, own)
        q = np.where(given, known, model.posterior(votes))
        weight = np.where(given, max(1.0, (~given).sum() / max(1, given.sum())), 1.0)
    return model


@dataclass
class ToxicModel:
    """The linear classifier: sorted features and their weights; its size is bounded by max_features."""

    feats: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        z = np.full(len(docs), self.bias)
        for i, d in enumerate(docs):
            if len(self.feats) and len(d):
                at = np.minimum(np.searchsorted(self.feats, d), len(self.feats) - 1)
                z[i] += self.weights[at[self.feats[at] == d]].sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_linear(rows: np.ndarray, cols: np.ndarray, n_cols: int, q: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on posterior labels q, by Adagrad; rows, cols: where a feature is present."""
    base = float(np.clip((weight * q).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    w, b = np.zeros(n_cols), float(np.log(base / (1 - base)))
    gw, gb = np.full(n_cols, 1e-8), 1e-8
    total = weight.sum()
    for _ in range(steps):
        z = b + np.bincount(rows, w[cols], len(q))
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) / total
        g, g0 = np.bincount(cols, d[rows], n_cols) + 1e-6 * w, d.sum()
        gw, gb = gw + g * g, gb + g0 * g0
        w, b = w - 0.3 * g / np.sqrt(gw), b - 0.3 * g0 / np.sqrt(gb)
    return w, float(b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
        found = pa.array([features(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "part", "label")), found, pa.array([bytes(pattern_votes(t)) for t in texts], pa.binary())], names=["doc_id", "part", "label", "feats", "patterns"])


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """(label, features, patterns) of the rows of a batch."""
    lists = batch.column("feats")
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    for i, (label, patterns) in enumerate(zip(batch.column("label").to_pylist(), batch.column("patterns").to_pylist(), strict=True)):
        yield label, values[ends[i] : ends[i + 1]].astype(np.int64), np.frombuffer(patterns, np.uint8)


def _counted(rows: DataFrame, weigh: Callable[[int | None, np.ndarray, np.ndarray], tuple[float, float]]) -> DataFrame:
    """(feature, one, all, n): per feature the sums of weigh(label, features, patterns) and how many rows have it; tasks sum first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_each(batch))
            if not found:
                continue
            told, sizes = [weigh(*row) for row in found], [len(feats) for _, feats, _ in found]
            used, at = np.unique(np.concatenate([feats for _, feats, _ in found]), return_inverse=True)
            sums = [np.bincount(at, np.repeat([t[k] for t in told], sizes), len(used)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, sums), pa.array(np.bincount(at, minlength=len(used)))], names=["feature", "one", "all", "n"])

    per_task = rows.select("label", "feats", "patterns").mapInArrow(run, "feature long, one double, all double, n long")
    # rounded so that the order of summation does not show
    return per_task.groupBy("feature").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("one", "all")), F.sum("n").alias("n"))


def read_lexicons(rows: DataFrame) -> Lexicons:
    """The features most typical of label 1 among the seeds of part READ; a bounded number of each family."""
    seeds = rows.filter(F.col("part") == READ)
    n = {r["label"]: r["count"] for r in seeds.groupBy("label").count().collect()}
    pos, neg = F.col("one"), F.col("all") - F.col("one")
    share_pos, share_neg = (pos + 0.05) / (n.get(1, 0) + 1), (neg + 0.5) / (n.get(0, 0) + 1)
    gain = F.round(F.log(share_pos / share_neg) * F.sqrt(pos), 9).alias("gain")
    counts = _counted(seeds, lambda label, feats, patterns: (float(label), 1.0))
    typical = store(counts.filter((pos >= 2) & (share_pos > 4 * share_neg)).select("feature", gain), "typical")
    best = [typical.filter(F.col("feature") % FAMILIES == f).orderBy(F.desc("gain"), "feature").limit(sum(TIERS)) for f in range(FAMILIES)]
    found = tiers([[r["feature"] for r in family.collect()] for family in best])
    discard(typical)
    return found


def fit(docs: DataFrame, labels: DataFrame, usable: Column, column: str = "toxic", *, seed_share: float = 0.4, seeds: int = 800, pool: int = 8000, max_features: int = 16_384) -> ToxicModel:
    """Train on labelled documents where `usable` holds (an expression on doc_id).

    Labels are looked at for a seed_share of each class, at most about `seeds` rows of it. `pool` bounds the other
    documents that the label model and the classifier see, without their labels.
    """
    spark = docs.sparkSession
    tune(spark)
    split = seeds_and_pool(docs, labels, column, usable, seed_share=seed_share, seeds=seeds, pool=pool)
    flat = ToxicModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(split.rate / (1 - split.rate))))
    if len(split.counts) < 2:
        return flat
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = split.rows.repartition(parts).mapInArrow(_extract, "doc_id long, part int, label int, feats array<int>, patterns binary")
    rows = store(rows, "features")
    lexicons = read_lexicons(rows)
    model, q, weight = _judge(rows, lexicons, split)
    base = float(np.clip((weight * q).sum() / weight.sum(), 1e-6, 1 - 1e-6)) if len(q) else split.rate
    shared, weights = spark.sparkContext.broadcast((lexicons, model)), split.weights

    def weigh(label: int | None, feats: np.ndarray, patterns: np.ndarray) -> tuple[float, float]:
        lex, told = shared.value
        w = 1.0 if label is None else weights[label]
        return w * float(told.posterior(lex.votes(feats, patterns).astype(np.float64)[None])[0]), w

    off = F.round(F.pow(F.col("one") - F.col("all") * base, 2) / (F.col("all") * (base * (1 - base)) + 1), 9).alias("off")
    best = _counted(rows, weigh).filter("n >= 2").select("feature", off).filter(F.col("off") > LEAST_OFF).orderBy(F.desc("off"), "feature").limit(max_features).collect()
    feats = np.sort(np.array([r["feature"] for r in best], np.int64))
    if not len(feats):
        discard(rows)
        return flat
    chosen = spark.sparkContext.broadcast(feats)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [np.packbits(np.isin(chosen.value, found, assume_unique=True)).tobytes() for _, found, _ in _each(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(has, pa.binary())], names=["doc_id", "has"])

    got = rows.select("doc_id", "label", "feats", "patterns").mapInArrow(present, "doc_id long, has binary").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    has = np.unpackbits(np.frombuffer(b"".join(got.column("has").to_pylist()), np.uint8).reshape(len(q), -1)[order], axis=1)[:, : len(feats)]
    discard(rows)
    return ToxicModel(feats, *train_linear(*np.nonzero(has), len(feats), q, weight))


def _judge(rows: DataFrame, lexicons: Lexicons, split: Split) -> tuple[LabelModel, np.ndarray, np.ndarray]:
    """The label model, and by doc_id the posterior label and the weight of every row of the sample."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [shared.value.votes(feats, patterns).tobytes() for _, feats, patterns in _each(batch)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "part", "label")), pa.array(votes, pa.binary())], names=["doc_id", "part", "label", "votes"])

    got = rows.mapInArrow(vote, "doc_id long, part int, label int, votes binary").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    votes = np.frombuffer(b"".join(got.column("votes").to_pylist()), np.uint8).reshape(-1, N_VOTERS)[order].astype(np.float64)
    known = np.array([-1 if v is None else v for v in got.column("label").to_pylist()], np.int64)[order]
    fresh = got.column("part").to_numpy()[order] >= DEVELOP  # the lexicons were not read off these
    model = fit_label_model(votes[fresh], split.rate, known[fresh])
    return model, model.posterior(votes), np.array([split.weights.get(int(k), 1.0) for k in known])


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """One row per document: doc_id, score, text_key."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score([features(t.as_py()) for t in batch.column("text").cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), batch.column("text_key")], names=["doc_id", "score", "text_key"])

    return corpus(docs).withColumn("text_key", text_key()).mapInArrow(run, "doc_id long, score double, text_key long")
