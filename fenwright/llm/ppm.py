"""LM scoring by prediction by partial matching (PPM), beside a word unigram base.

The model is a trie of byte contexts up to `order` bytes, counted over every
training document. A byte is coded in its longest context that occurred; where
it did not follow that context, an escape (method C: as many escapes as distinct
followers) leads to the next shorter context, from which the followers already
ruled out are excluded, and below order 0 all other byte values share what is
left. Followers of a context are a subset of those of its suffix, so what is
excluded is known for each context beforehand and scoring is a table look-up.

A text is coded as its words (A-Z lowered) joined by one space, then an end
mark, so that the model and the base give probabilities of the same event.

Gram and word counts are kept as tables of the whole corpus. What the `max_grams`
most frequent grams add is known before and sent to all executors, as are the
HEAD most frequent words; a row's other grams and words are joined. Of grams, the
distinct ones are first coded by tries over all grams that end their contexts alike.
So both sizes change the cost, not the scores.

Defined cases: null text counts as empty (its end mark is its only token); a null
doc_id belongs to the training part; repeated rows are counted and scored
each; without any training document all probabilities are uniform over bytes;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, cut, hashes
from .graph import in_groups

#: Words whose counts are sent to the executors: at most 2 MB for any corpus.
HEAD = 1 << 17
#: Bytes of context by which grams are dealt out; UTF-8 has few grams of so many bytes.
BASE = 3
START, END = 0xFE, 0xFF  # byte values that UTF-8 text never holds
SYMBOLS = 256
GROUP_BYTES = 4_000_000
SLICE_BYTES = 500_000  # scored at a time, as each byte takes some numbers
END_TOKEN = b"\n"  # no word holds white space


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Consecutive documents as word lists, about GROUP_BYTES at a time, with the first one's place."""
    at, size, words = 0, 0, []
    for i, t in enumerate(texts):
        words.append(t.lower().split())
        size += len(t)
        if size >= GROUP_BYTES:
            yield at, words
            at, size, words = i + 1, 0, []
    if words:
        yield at, words


def _buffers(words: list[list[bytes]], order: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes with `order` bytes of context in front of what is to be coded, and the document of each coded byte.

    A long document comes in slices that overlap by the context, so memory stays bounded and nothing is left out.
    """
    lead = bytes([START]) * order
    texts = [lead + b" ".join(w) + bytes([END]) for w in words]
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        raw = np.frombuffer(b"".join(texts[at:to]), np.uint8)
        doc = np.repeat(np.arange(at, to), [len(x) for x in texts[at:to]])
        for a in range(order, len(raw), most):
            b = min(len(raw), a + most)
            yield raw[a - order : b], doc[a:b]
        at = to


def _keys(raw: np.ndarray, order: int) -> np.ndarray:
    """Of each coded byte, its context of `order` bytes and itself as one number."""
    n = len(raw) - order
    key = raw[:n].astype(np.uint64)
    for i in range(1, order + 1):
        key <<= np.uint64(8)
        key |= raw[i : n + i]
    return key


def _summed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


_COUNTS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])


def count(docs: DataFrame, order: int) -> DataFrame:
    """kind, key, n: byte grams (0), words by hash (1) and all tokens (2) of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}

        def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], schema=_COUNTS)

        for batch in batches:
            for _, words in _groups(binary_column(batch, "text")):
                flat = [w for x in words for w in (*x, END_TOKEN)]
                yield rows(1, *_summed(hashes(flat, cache)))
                yield rows(2, np.zeros(1, np.int64), np.array([len(flat)]))
                for raw, _ in _buffers(words, order, GROUP_BYTES):
                    key = _keys(raw, order)
                    yield rows(0, *_summed(key[raw[order:] != START]))

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _levels(key: np.ndarray, n: np.ndarray, order: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams of orders least..order with their counts, from all grams of the longest order."""
    o = np.argsort(key)
    out = [(key[o], n[o].astype(np.float64))]
    for k in range(order - 1, least - 1, -1):
        k1, n1 = out[-1]
        short, to = np.unique(k1 & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        out.append((short, np.bincount(to, weights=n1, minlength=len(short))))
    return out[::-1]


class Trie:
    """Sorted grams and contexts of each order with what coding needs of them.

    `below` has the orders under those of `grams`.
    """

    LISTS = ("gram", "log_n", "context", "den", "esc", "den_less", "esc_less")

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], below: Trie | None = None):
        for x in self.LISTS:
            setattr(self, x, list(getattr(below, x)) if below else [])
        lower, total_below, distinct_below = below.last if below else (None,) * 3
        for g, c in grams:
            k = len(self.gram)
            ctx = g >> np.uint64(8)
            at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(g) else np.zeros(0, np.int64)
            own = ctx[at]
            total = np.add.reduceat(c, at) if len(g) else np.zeros(0)
            distinct = np.diff(np.append(at, len(g))).astype(np.float64)
            den, esc = self._logs(total, distinct)
            if k and len(g):  # what is left of the suffix context once this one's followers are excluded
                short = self._find(self.context[k - 1], own & np.uint64((1 << 8 * (k - 1)) - 1))
                gone = np.add.reduceat(lower[np.searchsorted(self.gram[k - 1], g & np.uint64((1 << 8 * k) - 1))], at)
                den_less, esc_less = self._logs(total_below[short] - gone, distinct_below[short] - distinct)
            else:
                den_less = esc_less = np.zeros(len(own))
            for x, v in zip(self.LISTS, (g, np.log10(c), own, den, esc, den_less, esc_less), strict=True):
                getattr(self, x).append(v)
            lower, total_below, distinct_below = c, total, distinct
        self.last = lower, total_below, distinct_below
        self.order = len(self.gram) - 1
        self.uniform = -np.log10(max(1, SYMBOLS - len(self.gram[0]))) if self.gram else 0.0

    @classmethod
    def of(cls, parts: dict) -> Trie:
        """A trie of parts = vars(trie): those are plain arrays, which any worker can read."""
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    @staticmethod
    def _logs(total: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the denominator and of the escape; 0 and 0 where no follower is left, as the escape is then certain."""
        some = distinct > 0.5
        den = np.where(some, total + distinct, 1.0)
        return np.log10(den), np.where(some, np.log10(np.maximum(distinct, 1)) - np.log10(den), 0.0)

    @staticmethod
    def _find(table: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is missing."""
        if not len(table):
            return np.full(len(key), -1)
        i = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return np.where(table[i] == key, i, -1)

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte in the context of its others."""
        log, above = np.zeros(len(key)), np.full(len(key), -1)
        open_ = np.arange(len(key))
        for k in range(self.order, -1, -1):
            if not len(open_):
                break
            gram = key[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            g = self._find(self.gram[k], gram)
            c = self._find(self.context[k], gram >> np.uint64(8))
            a = above[open_]
            den, esc = (self.den[k][c], self.esc[k][c]) if len(self.den[k]) else (np.zeros(len(open_)),) * 2
            if k < self.order and len(self.den_less[k + 1]):
                den = np.where(a >= 0, self.den_less[k + 1][a], den)
                esc = np.where(a >= 0, self.esc_less[k + 1][a], esc)
            hit = g >= 0
            if len(self.log_n[k]):
                log[open_] += np.where(hit, self.log_n[k][g] - den, np.where(c >= 0, esc, 0.0))
            above[open_] = c
            open_ = open_[~hit]
        log[open_] += self.uniform
        return log


class Head:
    """Values of grams by slot, one for each slot; grams that find theirs taken are in a sorted table."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(1.5 * len(key) + 1).bit_length())
        self.slot_key = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.slot_value = np.zeros(1 << self.bits, np.float32)
        o = np.argsort(key)
        key, value = key[o], value[o]
        s = self._slots(key)
        self.slot_key[s] = key
        kept = self.slot_key[s] == key
        self.slot_value[s[kept]] = value[kept]
        self.spilled, self.spilled_value = key[~kept], value[~kept]

    @classmethod
    def of(cls, parts: dict) -> Head:
        """A head of parts = vars(head): those are plain arrays, which any worker can read."""
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each gram, 0 for those that are not here, and the places of those."""
        slot = self._slots(key)
        out = self.slot_value[slot].astype(np.float64)
        at = np.flatnonzero(self.slot_key[slot] != key)
        if not len(at):
            return out, at
        i = Trie._find(self.spilled, key[at])
        out[at] = np.where(i >= 0, self.spilled_value[i] if len(self.spilled) else 0.0, 0.0)
        return out, at[i < 0]


def _head(grams: DataFrame, max_grams: int) -> Head:
    """The most frequent grams, at most max_grams, with their values."""
    sizes = grams.groupBy(F.length(F.bin("n")).alias("b")).count().orderBy(F.desc("b")).collect()
    least, size = 1 << 62, 0
    for r in sizes:
        size += r["count"]
        if size > max_grams:
            break
        least = 1 << r["b"] - 1
    context = Window.partitionBy(F.shiftrightunsigned("key", 8))
    value = F.log10("n") - F.log10(F.sum("n").over(context) + F.count("*").over(context))
    t = grams.select("key", "n", value.alias("v")).where(F.col("n") >= least).select("key", "v").toArrow()
    return Head(t.column("key").to_numpy().view(np.uint64), t.column("v").to_numpy())


def _values(grams: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """key, v: log10 probability of each asked gram, from the counts of all grams.

    Grams meet by the last BASE bytes of their context, so a group has all that
    the orders from BASE on need; the orders below are sent to every task.
    """
    base = min(BASE, order)
    mask = F.lit((1 << 8 * base) - 1).cast("long")
    below = None
    if base:
        t = grams.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        below = vars(Trie(_levels(t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy(), base - 1, 0)))
    sent = grams.sparkSession.sparkContext.broadcast(below)

    def run(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
        known = n > 0
        ask = key[~known]
        if len(ask):
            model = Trie(_levels(key[known], n[known], order, base), Trie.of(sent.value) if base else None)
            yield pa.RecordBatch.from_arrays([pa.array(ask.view(np.int64)), pa.array(model.score(ask))], names=["key", "v"])

    rows = grams.select("key", "n").unionAll(asked.select("key", F.lit(0).cast("long")))
    return in_groups(rows.select(F.shiftrightunsigned("key", 8).bitwiseAND(mask).alias("suffix"), "key", "n"), ["suffix"], run, "key long, v double", 200_000)


def _per_row(doc: np.ndarray, key: np.ndarray, m: int) -> tuple[pa.Array, pa.Array]:
    """Of each of m rows, its distinct keys and how often it has them."""
    o = np.lexsort((key, doc))
    doc, key = doc[o], key[o]
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(o) else o
    tf = np.diff(np.append(at, len(o))).astype(np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=m))]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(key[at].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(tf))


_SCORED = pa.schema(
    [
        ("row_key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("n_tail", pa.int64()), ("head", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32())),
        ("grams", pa.list_(pa.int64())), ("gram_tf", pa.list_(pa.int32())),
    ]
)


def _score(rows: DataFrame, frequent, head, order: int) -> DataFrame:
    """Per row: score over frequent grams, base score over head words, and its other grams and words (by hash) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        head_key, head_log = head.value
        model = Head.of(frequent.value)
        for batch in batches:
            for first, words in _groups(binary_column(batch, "text")):
                m = len(words)
                score = np.zeros(m)
                rare_doc, rare = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for raw, doc in _buffers(words, order, min(SLICE_BYTES, GROUP_BYTES)):
                    coded = raw[order:] != START
                    key, doc = _keys(raw, order)[coded], doc[coded]
                    log, at = model.look(key)
                    score += np.bincount(doc, weights=log, minlength=m)
                    rare_doc.append(doc[at])
                    rare.append(key[at])
                sizes = np.array([len(w) + 1 for w in words])
                h = hashes([w for x in words for w in (*x, END_TOKEN)], cache)
                doc = np.repeat(np.arange(m), sizes)
                i = Trie._find(head_key, h)
                known = i >= 0
                base = np.bincount(doc[known], weights=head_log[i[known]], minlength=m)
                n_known = np.bincount(doc[known], minlength=m)
                part = batch.slice(first, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row_key"), part.column("doc_id"), part.column("held_out"), pa.array(sizes.astype(np.int64)),
                        pa.array(n_known.astype(np.int64)), pa.array((sizes - n_known).astype(np.int64)), pa.array(base), pa.array(score),
                        *_per_row(doc[~known], h[~known], m), *_per_row(np.concatenate(rare_doc), np.concatenate(rare), m),
                    ],
                    schema=_SCORED,
                )

    out = "row_key long, doc_id long, held_out boolean, n_tokens long, n_known long, n_tail long, head double, score double, tail array<long>, tf array<int>, grams array<long>, gram_tf array<int>"
    return rows.mapInArrow(run, out)


def score(docs: DataFrame, order: int = 5, max_grams: int = 3_000_000, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Training uses the documents whose crc32(doc_id as text) modulo folds is not held_fold.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    fold = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(folds))
    rows = docs.select(
        F.xxhash64("doc_id", text).alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"),
        text.alias("text"),
    )
    counts = cut(count(rows.where(~F.col("held_out")), order))
    tokens = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    words = counts.where("kind = 1").select("key", "n")
    distinct = words.count()
    top = words.orderBy(F.desc("n"), "key").limit(HEAD).toArrow()
    key = top.column("key").to_numpy().view(np.uint64)
    o = np.argsort(key)
    head = spark.sparkContext.broadcast((key[o], np.log10(top.column("n").to_numpy()[o] + 0.5)))
    grams = counts.where("kind = 0").select("key", "n")
    frequent = spark.sparkContext.broadcast(vars(_head(grams, max_grams)))
    scored = cut(_score(rows, frequent, head, order))

    def rest(kind: int, keys: str, tf: str) -> DataFrame:
        return scored.select("row_key", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(tf).alias("tf"))).alias("x")).select("row_key", F.lit(kind).alias("kind"), "x.key", "x.tf")

    asked = scored.select(F.explode("grams").alias("key")).distinct()
    values = _values(grams, asked, order).select(F.lit(0).alias("kind"), "key", "v").unionAll(
        words.select(F.lit(1), "key", F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))
    )
    extra = (
        rest(0, "grams", "gram_tf").unionAll(rest(1, "tail", "tf"))
        .join(values, ["kind", "key"])
        .groupBy(F.col("row_key").alias("k"))
        .agg(
            F.sum(F.when(F.col("kind") == 0, F.col("tf") * F.col("v"))).alias("rare"),
            F.sum(F.when(F.col("kind") == 1, F.col("tf") * F.col("v"))).alias("more"),
            F.sum(F.when(F.col("kind") == 1, F.col("tf"))).alias("found"),
        )
    )
    same = F.count("*").over(Window.partitionBy("row_key"))
    total = F.log10(F.lit(tokens + 0.5 * (distinct + 1)))
    return (
        scored.drop("tail", "tf", "grams", "gram_tf")
        .select("*", same.alias("same"))
        .join(extra, F.col("row_key") == F.col("k"), "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce(F.col("found") / F.col("same"), F.lit(0))).cast("long").alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("head") + F.col("n_tail") * F.log10(F.lit(0.5)) + F.coalesce(F.col("more") / F.col("same"), F.lit(0.0)) - F.col("n_tokens") * total).alias("base_score"),
            (F.col("score") + F.coalesce(F.col("rare") / F.col("same"), F.lit(0.0))).alias("score"),
        )
    )
