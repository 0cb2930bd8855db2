"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and everything but letters becomes one space. Each
language has a model of four characters' order, learned from a bounded sample
of labelled documents. The models lie in sorted arrays of n-gram hashes, one
array for each order, with one column of log probabilities for each language;
an n-gram that one language knows has its (backed-off) probability filled in
for all, so one lookup serves every language. The language with the lowest
cross-entropy per character is chosen.

Rejection is calibrated on part of the sample that the models do not see: a
text is rejected when its cross-entropy, less what chance adds in a text of its
length, lies above nearly all of those texts by a margin. Texts that mix the
learned languages stay; texts in none of them go.
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

ORDER = 4
#: Bound of the sample: about so many labelled documents of each language, and so many of all languages together (20 of each at least).
SAMPLE = 600
SAMPLE_ALL = 20_000
#: Bytes of text that the sample takes in of all languages together; each has an equal share, and two documents of any length.
SAMPLE_BYTES = 96 << 20
#: Rejection: deviations that chance may add in short texts, share of the calibration texts below the limit, and the margin over it.
DEVIATIONS = 4.0
KEPT = 0.995
MARGIN = 1.1
#: Calibration texts that a language needs for a limit of its own.
CALIBRATED = 8
UNDETERMINED = "und"

_ODD = np.random.default_rng(11).integers(1 << 62, size=ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        for c in (*range(0xD800), *range(0xE000, 0x110000)):
            if chr(c).isalpha():
                table[c] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where each begins, and each one's letters.

    Each text is ``ORDER - 1`` spaces, then its letters with single spaces between, then a space if it ends in a letter.
    """
    pad = " " * (ORDER - 1)
    lowered = [pad + t.lower() + " " for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    begins = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for k in range(ORDER - 1):
        keep[begins + k] = True
    kept = np.add.reduceat(keep, begins, dtype=np.int64)
    count = np.add.reduceat(letter, begins, dtype=np.int64)
    codes = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    return codes, np.cumsum(kept) - kept, count


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """At each position the hashes of the 0 to ORDER characters that end there (0: a constant)."""
    out = [np.zeros(len(codes), np.uint64)]
    total = np.zeros(len(codes), np.uint64)
    for k in range(ORDER):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[k:] = codes[: len(codes) - k] * _ODD[k]
        total = total + shifted
        mixed = total ^ (total >> np.uint64(29))
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return out


class HashArray:
    """A sorted array of hashes, searched by the bucket of their top bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        bits = max(1, int(len(values)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(values >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)
        self.padded = np.append(values, np.uint64(0))
        self.longest = int(np.diff(self.starts).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place, or -1."""
        bucket = hashes >> self.shift
        at = self.starts[bucket]
        found = np.where(self.padded[at] == hashes, at, -1)
        found[at >= len(self.values)] = -1
        todo = np.flatnonzero(found < 0)
        end = self.starts[bucket[todo] + np.uint64(1)]
        at = at[todo]
        for _ in range(self.longest - 1):
            at = at + 1
            more = at < end
            todo, at, end = todo[more], at[more], end[more]
            if not len(todo):
                break
            hit = self.padded[at] == hashes[todo]
            found[todo[hit]] = at[hit]
            todo, at, end = todo[~hit], at[~hit], end[~hit]
        return found


@dataclass
class _Level:
    """One language's n-grams of one order: sorted hashes, counts, and the hashes of their contexts and endings."""

    grams: np.ndarray
    counts: np.ndarray
    context: np.ndarray
    ending: np.ndarray


def _levels(texts: list[str]) -> list[_Level]:
    """Counts of one language: raw at the highest order, numbers of distinct continuations below."""
    codes, begins, _ = normalised(texts)
    hashes = _hashes(codes)
    scored = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        scored[begins + k] = False
    at = np.flatnonzero(scored)
    grams, first, counts = np.unique(hashes[ORDER][at], return_index=True, return_counts=True)
    levels = []
    where = at[first]
    for k in range(ORDER, 0, -1):
        context = hashes[k - 1][where - 1] if k > 1 else np.zeros(len(where), np.uint64)
        levels.append(_Level(grams, counts, context, hashes[k - 1][where]))
        if k > 1:
            grams, first, counts = np.unique(hashes[k - 1][where], return_index=True, return_counts=True)
            where = where[first]
    return levels[::-1]


class LanguageModels:
    """The models of all languages in shared sorted hash arrays."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        own = [_levels(texts[lang]) for lang in self.languages]
        size = len(np.unique(np.concatenate([x[0].grams for x in own]))) + 1
        below = np.full((1, len(own)), 1.0 / size)
        below_at = HashArray(np.zeros(1, np.uint64))
        self.grams: list[HashArray] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[HashArray] = []
        self.weights: list[np.ndarray] = []
        for k in range(ORDER):
            every, first = np.unique(np.concatenate([x[k].grams for x in own]), return_index=True)
            context = np.concatenate([x[k].context for x in own])[first]
            ending = np.concatenate([x[k].ending for x in own])[first]
            lower = below[below_at.find(ending)] if k else np.repeat(below, len(every), 0)
            contexts = np.unique(context)
            context_at = np.searchsorted(contexts, context)
            weight = np.ones((len(contexts), len(own)))
            p = np.empty((len(every), len(own)))
            for col, levels in enumerate(own):
                level = levels[k]
                ones, twos = int((level.counts == 1).sum()), int((level.counts == 2).sum())
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                place = np.searchsorted(contexts, level.context)
                total = np.bincount(place, level.counts, len(contexts))
                kinds = np.bincount(place, minlength=len(contexts))
                known = total > 0
                weight[known, col] = discount * kinds[known] / total[known]
                p[:, col] = weight[context_at, col] * lower[:, col]
                p[np.searchsorted(every, level.grams), col] += (level.counts - discount) / total[place]
            self.grams.append(HashArray(every))
            self.logs.append(np.log(p).astype(np.float32))
            self.contexts.append(HashArray(contexts))
            self.weights.append(np.log(weight).astype(np.float32))
            below, below_at = p, self.grams[-1]
        self.unseen = np.float32(-np.log(size))
        self.centre, self.within = np.full(len(own), np.inf), np.zeros(len(own))
        self.limit = MARGIN
        self.heat = 0.1

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, the characters scored, and the letters."""
        codes, begins, letters = normalised(texts)
        hashes = _hashes(codes)
        logs = np.zeros((len(codes), len(self.languages)), np.float32)
        scored = np.ones(len(codes), bool)
        for k in range(ORDER - 1):
            scored[begins + k] = False
        todo = np.flatnonzero(scored)
        for k in range(ORDER, 0, -1):
            if not len(todo):
                break
            found = self.grams[k - 1].find(hashes[k][todo])
            hit = found >= 0
            if k == ORDER:
                logs[todo[hit]] = self.logs[k - 1][found[hit]]
            else:
                logs[todo[hit]] += self.logs[k - 1][found[hit]]
            todo = todo[~hit]
            context = self.contexts[k - 1].find(hashes[k - 1][todo - 1] if k > 1 else np.zeros(len(todo), np.uint64))
            seen = context >= 0
            logs[todo[seen]] += self.weights[k - 1][context[seen]]
        logs[todo] += self.unseen
        count = np.add.reduceat(scored, begins, dtype=np.int64)
        total = -np.add.reduceat(logs, begins, axis=0, dtype=np.float64)
        return total / np.maximum(count, 1)[:, None], count, letters

    def calibrate(self, texts: dict[str, list[str]], learned: dict[str, list[str]] | None = None) -> None:
        """The limit of rejection, and how sharply differences tell languages apart.

        A language with too few texts for a limit of its own gets the others'
        median centre and spread, or a higher centre if its texts (``learned``
        has those that its model saw) have one under models of half of them.
        """
        rows, counts, truth = [], [], []
        for col, lang in enumerate(self.languages):
            held = [t for t in texts.get(lang, []) if t]
            for part in slices(held):
                entropy, count, letters = self.entropies(part)
                rows.append(entropy[letters > 0])
                counts.append(count[letters > 0])
                truth.append(np.full(int((letters > 0).sum()), col))
        entropy = np.concatenate(rows) if rows else np.empty((0, len(self.languages)))
        count, label = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (counts, truth))
        ratios = []
        for col in range(len(self.languages)):
            own, length = entropy[label == col, col], count[label == col]
            if len(own) < CALIBRATED:
                continue
            self.centre[col] = np.median(own)
            # by a median, so that stray labels do not count
            self.within[col] = 1.4826 * np.median(np.abs(own - self.centre[col]) * np.sqrt(length))
            ratios.append((own - DEVIATIONS * self.within[col] / np.sqrt(length)) / self.centre[col])
        if ratios:
            self.limit = MARGIN * max(1.0, float(np.quantile(np.concatenate(ratios), KEPT)))
        self._pool(texts, learned or {})
        if len(entropy):
            rank = []
            for heat in (heats := np.geomspace(0.005, 1.0, 12)):
                shifted = -(entropy - entropy.min(1, keepdims=True)) * count[:, None] * heat
                p = np.exp(shifted[np.arange(len(label)), label] - np.log(np.exp(shifted).sum(1)))
                rank.append(-np.log(np.maximum(p, 1e-6)).mean())
            self.heat = float(heats[int(np.argmin(rank))])

    def _pool(self, texts: dict[str, list[str]], learned: dict[str, list[str]]) -> None:
        """Centre and spread of the languages without a limit of their own."""
        own = np.isfinite(self.centre)
        crossed = {}
        for col in np.flatnonzero(~own).tolist():
            lang = self.languages[col]
            found = _crossed([*learned.get(lang, []), *texts.get(lang, [])])
            if len(found):
                crossed[col] = float(np.median(found))
        centres = self.centre[own] if own.any() else np.array(list(crossed.values()))
        if not len(centres):
            return
        pooled = float(np.median(centres))
        if own.any():
            self.within[~own] = np.median(self.within[own])
        for col in np.flatnonzero(~own).tolist():
            self.centre[col] = max(pooled, crossed.get(col, pooled))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, probability, cross-entropy and acceptance of each text."""
        entropy, count, letters = self.entropies(texts)
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(-(entropy - lowest[:, None]) * count[:, None] * self.heat).sum(1)
        limit = self.centre[best] * self.limit + DEVIATIONS * self.within[best] / np.sqrt(np.maximum(count, 1))
        some = letters > 0
        accepted = some & (lowest <= limit)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), some.tolist())]
        return names, np.where(some, score, 0.0), np.where(some, lowest, 0.0), accepted


def _crossed(texts: list[str]) -> np.ndarray:
    """Cross-entropies of a language's few texts, each half under a model of the other half."""
    texts = [t for t, n in zip(texts, normalised(texts)[2].tolist()) if n] if texts else []
    if len(texts) < 2:
        return np.empty(0)
    halves = texts[::2], texts[1::2]
    return np.concatenate([LanguageModels({"": a}).entropies(b)[0][:, 0] for a, b in (halves, halves[::-1])])


def learn(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", sample: int = SAMPLE) -> LanguageModels | None:
    """Models from a bounded sample of labelled rows, drawn by a hash of the row; None without any labelled text.

    Every value of ``lang_column`` is learned. The sample holds about ``sample``
    documents of each (fewer where there are more than ``SAMPLE_ALL / sample``
    languages, but 20), within ``SAMPLE_BYTES`` bytes of text and of any length
    each. Every fifth document is kept for calibration, but none of a language
    that would have no document with a letter for its model.
    """
    usable = labelled.where(F.col(lang_column).isNotNull() & (F.octet_length(text_column) > 0))
    rows = usable.groupBy(F.col(lang_column).cast("string").alias("g")).agg(F.count("*").alias("n")).collect()  # a row for each language
    if not rows:
        return None
    each = min(sample, max(20, SAMPLE_ALL // len(rows)))
    share = labelled.sparkSession.createDataFrame([(r.g, share_of(each, r.n)) for r in rows], "g string, share long")
    picked = usable.select(F.col(lang_column).cast("string").alias("g"), F.col(text_column).alias("t"), draw_of("sample", id_column, text_column).alias("draw"))
    # few rows of a language may all draw high numbers: then its lowest draw is taken
    lowest = picked.groupBy("g").agg(F.min("draw").alias("lowest"))
    share = share.join(lowest, "g").select("g", F.greatest("share", F.col("lowest") + 1).alias("share"))
    drawn = picked.join(F.broadcast(share), "g").where("draw < share").select("g", "t", "draw")
    picked = bounded_rows(drawn, "g", "draw", "t", 2 * each, SAMPLE_BYTES // len(rows))
    texts: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.g, r.draw, r.t)):
        (held if r.draw % 5 == 0 else texts).setdefault(r.g, []).append(r.t)
    for g in list(held):
        if not normalised(texts.get(g, [""]))[2].sum():
            texts.setdefault(g, []).extend(held.pop(g))
    texts = {g: own for g, own in texts.items() if normalised(own)[2].sum()}
    if not texts:
        return None
    models = LanguageModels(texts)
    models.calibrate(held, texts)
    return models


def identify(df: DataFrame, models: LanguageModels | None, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, lang_pred, score, entropy, accepted, and the columns named in ``keep``.

    Null texts and texts without a letter are ``und`` with score 0, and not
    accepted; so is everything if there are no models. A text of any length is
    read whole. Repeated rows stay repeated; an empty table gives an empty result.
    """
    sent = df.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    plain = [id_column, text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for done, part in text_parts(batch, text_column):
                if own is None:
                    found = [UNDETERMINED] * len(part), *[np.zeros(len(part))] * 2, np.zeros(len(part), bool)
                else:
                    found = own.predict(part)
                kept = [batch.column(k).slice(done, len(part)) for k in range(batch.num_columns) if out_index[k]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in found)], names=names)

    columns = list(dict.fromkeys([*plain, *keep]))
    out_index = [c == id_column or c in keep for c in columns]
    kept = [c for c, ok in zip(columns, out_index) if ok]
    names = [*kept, "lang_pred", "score", "entropy", "accepted"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*columns).mapInArrow(run, f"{schema}, lang_pred string, score double, entropy double, accepted boolean")


def identified(df: DataFrame, folds: int = 4, held_out: int = 2, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts every row: id, held_out, lang_pred, score, accepted."""
    models = learn(df.where(fold(id_column, folds) != held_out), text_column, lang_column, id_column)
    out = identify(df, models, id_column, text_column)
    return out.select(id_column, (fold(id_column, folds) == held_out).alias("held_out"), "lang_pred", "score", "accepted")
