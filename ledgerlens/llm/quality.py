"""Text quality by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is a draw of
all documents; bad examples are not used. With the share of good documents (the
class prior) known, the risk of a classifier follows from the two sets alone:
the loss on positives, plus the loss of calling unlabelled documents good less
the part of it that positives account for. That last difference is a risk and
is kept from falling below zero (the non-negative estimator): when it does, the
step goes the other way.

The prior is estimated from how far the positives' scores cover the unlabelled
ones.
Features look at the form of a text only (kinds of characters and their
neighbours, repetition, lengths), over the whole text and in its worst stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_rows, draw_of, fold, share_of, text_parts
from ledgerlens.llm.memo import slices

#: Bound of each of the two samples that the classifier is fitted on.
SAMPLE = 3000
#: Bytes of text that each sample takes in (and two documents of any length at least).
SAMPLE_BYTES = 24 << 20
#: Characters, and words, of a stretch.
STRETCH = 256
STRETCH_WORDS = 32
STEPS = 300
#: The non-negative estimator turns back when the negative risk falls below minus this.
SLACK = 0.0
PENALTY = 1e-4

_CLASSES = 14
_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Kind of each code point: letters by case, digits, spaces, and groups of signs."""
    if not _TABLE:
        table = np.full(0x110000, 13, np.uint8)
        for c in range(0x3000):
            s = chr(c)
            if s.islower():
                table[c] = 0
            elif s.isupper():
                table[c] = 1
            elif s.isalpha():
                table[c] = 2
            elif s.isdigit():
                table[c] = 3
        for c in range(0x3000, 0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                table[c] = 2
        for kind, signs in enumerate([" \t", "\n\r\x0b\x0c", ".", ",;:", "!?", "'\"-()", "|/\\", "@#$%^&*~_+=", "<>[]{}`"], 4):
            for s in signs:
                table[ord(s)] = kind
        _TABLE.append(table)
    return _TABLE[0]


def _worst(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """For each text the highest mean of ``values`` over its stretches of ``width`` (its whole if shorter)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    counts = np.maximum(1, sizes // max(1, width // 2) - 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begins[owner] + number * (width // 2)
    last = number == counts[owner] - 1
    end = np.where(last, begins[owner] + sizes[owner], start + width)
    means = (total[end] - total[start]) / np.maximum(1, end - start)
    return np.maximum.reduceat(means, np.cumsum(counts) - counts)


def features(texts: list[str]) -> np.ndarray:
    """A row of numbers for each text; an empty text has zeros in nearly all."""
    n = len(texts)
    padded = [t + "\n" for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, n)
    begins = np.cumsum(sizes) - sizes
    kinds = _table()[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    pair = kinds[:-1].astype(np.int64) * _CLASSES + kinds[1:]
    same = owner[:-1] == owner[1:]
    square = _CLASSES * _CLASSES
    pairs = np.bincount((owner[:-1] * square + pair)[same], minlength=n * square).reshape(n, square)
    pairs = np.sqrt(pairs / np.maximum(1, sizes - 1)[:, None])
    worst = [_worst(own, begins, sizes, STRETCH) for own in (kinds == 1, kinds == 3, kinds == 8, kinds > 9, (kinds > 5) | (kinds == 3))]

    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, n)
    flat = [w for own in words for w in own]
    marks = np.fromiter(map(hash, flat), np.int64, len(flat)) if flat else np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat)) if flat else np.zeros(0, np.int64)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    repeat, back, long = np.zeros((3, n))
    extra = np.zeros((n, 8))
    if len(flat):
        number = np.repeat(np.arange(len(starts)), counts[some])
        again = np.r_[False, (marks[1:] == marks[:-1]) & (number[1:] == number[:-1])]
        repeat[some] = _worst(again, starts, counts[some], STRETCH_WORDS)
        two = np.zeros(len(flat), bool)
        two[2:] = (marks[2:] == marks[:-2]) & (number[2:] == number[:-2])
        back[some] = _worst(two, starts, counts[some], STRETCH_WORDS)
        long[some] = _worst(lengths > 18, starts, counts[some], STRETCH_WORDS)
        total = counts[some]
        extra[some, 0] = np.add.reduceat(again, starts, dtype=np.float64) / total
        extra[some, 1] = np.array([len(set(w)) for w in words if w]) / np.sqrt(total)
        extra[some, 2] = np.array([len(set(w)) for w in words if w]) / total
        extra[some, 3] = np.add.reduceat(lengths, starts) / total / 10
        extra[some, 4] = np.maximum.reduceat(lengths, starts) ** 0.5 / 10
    lines = [t.split("\n") for t in texts]
    extra[:, 5] = [1 - len(set(own)) / len(own) for own in lines]
    extra[:, 6] = np.log1p(counts) / 5
    extra[:, 7] = [np.log1p(len(t) / len(own)) / 5 for t, own in zip(texts, lines)]
    return np.column_stack([pairs, np.sqrt(np.column_stack(worst)), repeat, back, long, extra]).astype(np.float32)


@dataclass
class QualityModel:
    """A linear score over scaled features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability-like score of each text, 0 to 1."""
        x = np.clip((features(texts) - self.centre) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40).astype(np.float64)))


def covered_share(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from scores: the ratio of the unlabelled to the positive share above a threshold, where its upper confidence bound is least."""
    order = np.sort(np.unique(np.r_[positive, unlabelled]))[:-1]
    if not len(order):
        return 1.0
    above = lambda own: 1 - np.searchsorted(np.sort(own), order, "right") / len(own)
    p, u = above(positive), above(unlabelled)
    room = np.sqrt(1 / len(positive)) + np.sqrt(1 / len(unlabelled))
    p, u = p[p > 0], u[p > 0]
    if not len(p):
        return 1.0
    best = int(np.argmin((u + room) / p))
    return float(np.clip(u[best] / p[best], 0.01, 1.0))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Minimises the non-negative risk of a linear score with logistic loss, by Adam over whole samples."""
    w = np.zeros(p.shape[1] + 1, np.float32)
    p, u = (np.column_stack([x, np.ones(len(x))]).astype(np.float32) for x in (p, u))
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.logaddexp(0, z)  # noqa: E731  of calling it good
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        gain = -(p.T @ sigma(-zp)) / len(p) * prior
        negative = loss(zu).mean() - prior * loss(zp).mean()
        slope = (u.T @ sigma(zu)) / len(u) - prior * (p.T @ sigma(zp)) / len(p)
        gradient = gain + slope if negative >= -SLACK else -slope
        gradient = gradient + PENALTY * np.r_[w[:-1], 0]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = (w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w[:-1], float(w[-1])


def fit(positive: list[str], unlabelled: list[str], prior: float | None = None) -> QualityModel | None:
    """The model of two samples; None without positives or unlabelled texts."""
    if not positive or not unlabelled:
        return None
    p, u = (np.concatenate([features(x) for x in slices(s)]) for s in (positive, unlabelled))
    centre, scale = u.mean(0), u.std(0) + 1e-3
    p, u = (np.clip((x - centre) / scale, -8, 8).astype(np.float64) for x in (p, u))
    if prior is None:
        # each half of the samples tells them apart, and the other half says how far the positives cover the unlabelled
        found = []
        for a, b in ((0, 1), (1, 0)):
            if len(p) > 1 and len(u) > 1:
                w, bias = _descend(p[a::2], u[a::2], 0.5)
                found.append(covered_share(p[b::2] @ w + bias, u[b::2] @ w + bias))
        prior = float(np.mean(found)) if found else 0.5
    prior = float(np.clip(prior, 0.01, 0.99))
    w, b = _descend(p, u, prior)
    return QualityModel(centre, scale, w.astype(np.float32), b, prior)


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> QualityModel | None:
    """Fits on two bounded draws by a hash of the row: of documents labelled 1, and of all documents of ``docs``.

    Labels 0 are not read. Where labels contradict each other for an id, a 1
    counts. About ``sample`` texts are drawn of each kind, within
    ``SAMPLE_BYTES`` bytes and of any length each; ids may be of any type, and
    null or repeated.
    """
    clean = labels.where(F.col(id_column).isNotNull() & (F.col(label_column) == 1)).select(F.col(id_column).alias("i")).distinct()
    good, rows = clean.count(), docs.count()
    if not good or not rows:
        return None
    # the draw of labelled ids has about ``sample`` rows, so it is sent to where the texts are; documents may cover few of the ids
    own = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t"))
    covered = own.select("i").distinct().join(clean, "i").select("i")
    share = share_of(sample, covered.count())
    chosen = F.broadcast(covered.where(draw_of("draw", "i") < share))
    own = own.withColumns({"draw": draw_of("draw", "i", "t"), "other": draw_of("other", "i", "t")})
    trusted = own.join(chosen, "i", "left_semi").select(F.lit(1).alias("kind"), "draw", "t")
    trusted = trusted.where(F.col("draw") < share_of(sample, trusted.count()))
    every = own.where(F.col("other") < share_of(sample, rows)).select(F.lit(0).alias("kind"), F.col("other").alias("draw"), "t")
    both = bounded_rows(trusted.unionByName(every), "kind", "draw", "t", 2 * sample, SAMPLE_BYTES).collect()
    both.sort(key=lambda r: (r.kind, r.draw))
    return fit([r.t or "" for r in both if r.kind], [r.t or "" for r in both if not r.kind])


def scored(df: DataFrame, model: QualityModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1, higher is better) and predicted (1 from 0.5 on).

    Null texts score as empty ones; a text of any length is read whole. Without
    a model every score is 0.5. Repeated rows stay repeated; other columns are
    ignored; an empty table gives an empty result.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            parts = [own.scores(part) if own else np.full(len(part), 0.5) for _, part in text_parts(batch, "t")]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["i", "score", "predicted"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(run, f"i {kind}, score double, predicted int")
    return out.withColumnRenamed("i", id_column)


def good_rows(docs: DataFrame, model: QualityModel | None, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model calls good; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            parts = [own.scores(part) >= 0.5 if own else np.ones(len(part), bool) for _, part in text_parts(batch, text_column)]
            yield batch.filter(pa.array(np.concatenate(parts) if parts else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def classified(df: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Learns from documents and labels outside the held-out fold, scores every document: id, held_out, score, predicted."""
    outside = fold(id_column, folds) != held_out
    model = learn(df.where(outside), labels.where(outside), id_column, text_column)
    return scored(df, model, id_column, text_column).select(id_column, (fold(id_column, folds) == held_out).alias("held_out"), "score", "predicted")
