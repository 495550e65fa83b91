"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Votes are
counted by pattern over the whole corpus (at most 3 ** labellers patterns), and
expectation-maximisation estimates from the counts how often each labeller
votes what on good and on bad documents; that gives every pattern a posterior.
The posteriors of a sample train a logistic scorer over hashed features: byte
trigrams and the votes. The scorer judges all documents.

The sample is a hash-chosen set of about `sample_rows` documents (the one
bounded step; its bound is the parameter). Everything else reads all rows.

Defined cases: documents without words (null, empty or blank text) score 0 and
are rejected; repeated rows are judged each; an empty table gives no rows;
`keep_good` returns every column of its input as it is, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD, BAD, NONE = 1, 0, 2

# Frequent function words of the four languages.
STOP = frozenset(
    w.encode()
    for w in (
        "the of and to in is that for it with as was on be by this are from or an a "
        "der die das und zu den von mit ist auf für im dem nicht ein eine als auch es sich "
        "le la les de des et un une du en que qui dans pour par sur pas au est "
        "el los las y del se por con para una su al lo como más"
    ).split()
)
_SYMBOLS = np.array([c in b"#*$%&|<>" for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC3 for c in range(256)])


def _vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def symbols(d: dict) -> int:
    return _vote(d["symbols"] < 0.01 * d["bytes"], d["symbols"] > 0.05 * d["bytes"])


def capitals(d: dict) -> int:
    return _vote(d["upper"] < 0.2 * d["letters"], d["letters"] > 0 and d["upper"] > 0.5 * d["letters"])


def shouting(d: dict) -> int:
    return _vote(d["marks"] < 0.05 * d["n"], d["marks"] > 0.2 * d["n"])


def stutter(d: dict) -> int:
    """Words that equal the word before."""
    return NONE if d["n"] < 10 else _vote(d["same"] < 0.05 * d["n"], d["same"] > 0.2 * d["n"])


def variety(d: dict) -> int:
    """Distinct words among the first words; of long texts that share falls by nature."""
    return NONE if d["n"] < 20 else _vote(d["distinct"] > 0.3 * d["n"] or d["distinct"] > 500, d["distinct"] < 0.15 * d["n"] and d["distinct"] < 200)


def function_words(d: dict) -> int:
    return NONE if d["n"] < 20 else _vote(d["stop"] > 0.1 * d["n"], d["stop"] < 0.05 * d["n"])


def lists(d: dict) -> int:
    """Separators that stand alone between words."""
    return _vote(d["bars"] < 0.01 * d["n"], d["bars"] > 0.1 * d["n"])


def lines(d: dict) -> int:
    return NONE if d["lines"] < 4 else _vote(d["dup_lines"] < 0.1 * d["lines"], d["dup_lines"] > 0.4 * d["lines"])


LABELLERS = (symbols, capitals, shouting, stutter, variety, function_words, lists, lines)


def describe(text: bytes) -> dict:
    """What the labellers look at."""
    words = text.lower().split()
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    rows = [x for x in text.split(b"\n") if x.strip()]
    return {
        "bytes": len(text), "n": len(words), "symbols": int(seen[_SYMBOLS].sum()), "upper": int(seen[_UPPER].sum()), "letters": int(seen[_LETTER].sum()),
        "marks": int(seen[33]), "same": sum(map(bytes.__eq__, words, words[1:])), "distinct": len(set(words)), "stop": sum(map(STOP.__contains__, words)),
        "bars": words.count(b"|"), "lines": len(rows), "dup_lines": len(rows) - len(set(rows)),
    }


def votes(text: bytes) -> list[int]:
    d = describe(text)
    return [f(d) for f in LABELLERS]


def _code(v: list[int]) -> int:
    out = 0
    for x in v:
        out = 3 * out + x
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()]


def patterns(docs: DataFrame) -> DataFrame:
    """pattern, n: how many documents got each pattern of votes; documents without words are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [_code(votes(t)) for t in _texts(b) if t.strip()]
            key, n = np.unique(np.array(codes, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def label_model(pattern: np.ndarray, n: np.ndarray, labellers: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over pattern counts: posterior of `good` by pattern code, and P(vote | class, it votes) of each labeller.

    That a labeller does not vote tells nothing about the class. Starts from the share of good votes, so that class 1 stays the good one.
    """
    every = np.arange(3**labellers)
    digit = np.stack([every // 3 ** (labellers - 1 - j) % 3 for j in range(labellers)], 1)
    v = digit[pattern]
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    p = (good + 1.0) / (good + 3.0 * bad + 2.0)
    table = np.full((labellers, 2, 3), 1.0)
    prior = 0.5
    for _ in range(rounds):
        for c, w in ((1, n * p), (0, n * (1 - p))):
            for j in range(labellers):
                voted = np.bincount(v[:, j], weights=w, minlength=3)[:2] + 0.5
                table[j, c, :2] = voted / voted.sum()
        prior = (n @ p + 1) / (n.sum() + 2)
        log = [np.log(q) + sum(np.log(table[j, c][v[:, j]]) for j in range(labellers)) for c, q in ((1, prior), (0, 1 - prior))]
        p = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
    log = [np.log(q) + sum(np.log(table[j, c][digit[:, j]]) for j in range(labellers)) for c, q in ((1, prior), (0, 1 - prior))]
    return 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500))), table


#: Width of the hashed feature vector; two more per labeller hold its vote.
WIDTH = 1 << 12
_STEP = 4_000_000


def trigrams(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams over the whole text."""
    out = np.zeros(WIDTH, np.int64)
    for a in range(0, max(0, len(text) - 2), _STEP):
        x = np.frombuffer(text[a : a + _STEP + 2], np.uint8).astype(np.uint32)
        if len(x) > 2:
            h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
            out += np.bincount(h, minlength=WIDTH)
    return out


def features(texts: list[bytes], voted: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(texts), WIDTH + 2 * len(LABELLERS)), np.float32)
    for i, (t, v) in enumerate(zip(texts, voted, strict=True)):
        c = trigrams(t)
        x[i, :WIDTH] = np.sqrt(c / max(1, c.sum()))
        x[i, [WIDTH + 2 * j + y for j, y in enumerate(v) if y != NONE]] = 1
    return x


def train(x: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for soft labels; both classes weigh the same."""
    w = np.zeros(x.shape[1] + 1)
    good = max(target.sum(), 1e-9)
    bad = max((1 - target).sum(), 1e-9)
    up, down = 0.5 * target / good, 0.5 * (1 - target) / bad
    m, s = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30)))
        e = p * down - (1 - p) * up
        g = np.append(x.T @ e.astype(np.float32) + ridge * w[:-1], e.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return w


def fit(docs: DataFrame, sample_rows: int = 4000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Posterior by vote pattern, and the scorer's weights."""
    counted = patterns(docs).toPandas()
    codes, n = counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(np.float64)
    width = WIDTH + 2 * len(LABELLERS) + 1
    if not len(codes):
        return np.full(3 ** len(LABELLERS), 0.5), np.zeros(width)
    posterior, _ = label_model(codes, n, len(LABELLERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in _texts(b):
                if t.strip():
                    v = votes(t)
                    c = trigrams(t)
                    on = np.flatnonzero(c).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_code(v)]), pa.array([on.tolist()], pa.list_(pa.int32())), pa.array([np.sqrt(c[on] / c.sum()).tolist()], pa.list_(pa.float32()))] if len(on)
                        else [pa.array([_code(v)]), pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.float32()))],
                        names=["pattern", "place", "value"],
                    )

    share = min(1.0, sample_rows / n.sum())
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1)
    got = docs.where(chosen).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long, place array<int>, value array<float>").toArrow()
    m = got.num_rows
    if not m:
        return posterior, np.zeros(width)
    x = np.zeros((m, width - 1), np.float32)
    code = got.column("pattern").to_numpy()
    for i, (at, value) in enumerate(zip(got.column("place"), got.column("value"), strict=True)):
        x[i, at.values.to_numpy()] = value.values.to_numpy()
    for j in range(len(LABELLERS)):
        vote = code // 3 ** (len(LABELLERS) - 1 - j) % 3
        x[np.flatnonzero(vote != NONE), WIDTH + 2 * j + vote[vote != NONE]] = 1
    return posterior, train(x, posterior[code])


def _judge(texts: list[bytes], posterior: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label, score = np.zeros(len(texts)), np.zeros(len(texts))
    for a in range(0, len(texts), 256):
        part = texts[a : a + 256]
        voted = [votes(t) for t in part]
        some = np.array([bool(t.strip()) for t in part])
        z = features(part, voted) @ weights[:-1].astype(np.float32) + weights[-1]
        label[a : a + 256] = np.where(some, posterior[[_code(v) for v in voted]], 0.0)
        score[a : a + 256] = np.where(some, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
    return label, score


def classify(docs: DataFrame, threshold: float = 0.5, sample_rows: int = 4000) -> DataFrame:
    """doc_id, label (posterior of the weak labels), score and kept of every document."""
    posterior, weights = fit(docs, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, score = _judge(_texts(b), posterior, weights)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(label), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "label", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, label double, score double, kept boolean")


def keep_good(docs: DataFrame, threshold: float = 0.5, sample_rows: int = 4000) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    posterior, weights = fit(docs, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_judge(_texts(b), posterior, weights)[1] >= threshold))

    return docs.mapInArrow(run, docs.schema)
