"""SentencePiece (byte-pair merge type) encoding and decoding by a prefix table.

A merge encoding is determined by its neighbouring pairs: a sequence of tokens
is the encoding of its text exactly if each two neighbours are what the merges
make of the two tokens' joined text. So every prefix of a text has one last
token. The table of last tokens is filled from left to right: an automaton
reports the vocabulary's pieces that end at a position, and the one that is
compatible with the last token of the prefix before it is stored. The ids are
then recovered from the end backwards. Time is linear in the text, whatever
its length.

Characters outside the vocabulary become byte pieces and never merge; no piece
holds a word mark behind another character (checked on loading), so a text
falls apart into words, whose ids are remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_parts
from ledgerlens.llm.memo import WORDS, WordMemo, slices

MARK = "▁"
#: Answers of the pair test that a worker keeps.
PAIRS = 400_000


class PrefixTableCodec:
    """Encodes and decodes as the model at ``path`` does, without begin, end or sampling."""

    def __init__(self, path: str, words: int = WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(k) for k in range(size)]
        special = [model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k) for k in range(size)]
        self.bytes_from = next(k for k in range(size) if model.is_byte(k))
        if not all(model.is_byte(self.bytes_from + b) for b in range(256)):
            raise ValueError("the model has no byte pieces")
        self.unknown = {k for k in range(size) if model.is_unknown(k)}
        self.shown = [" ⁇ " if k in self.unknown else "" if model.is_control(k) else p for k, p in enumerate(self.pieces)]
        for b in range(128):
            self.shown[self.bytes_from + b] = chr(b)
        self.ids = {p: k for k, p in enumerate(self.pieces) if not special[k]}
        #: Merge order: the piece with the highest score first.
        self.rank = {p: -model.get_score(k) for p, k in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on past a word's end")
        self.lines = not any("\n" in p for p in self.ids)
        self.chars = {p for p in self.ids if len(p) == 1}
        #: Of every piece that merging makes: the two parts of its last merge and the time it is made.
        self.parts: dict[int, tuple[int, int]] = {}
        self.made = {self.ids[c]: -np.inf for c in self.chars}
        for piece in sorted((p for p in self.ids if len(p) > 1), key=len):
            if not self.chars.issuperset(piece):
                continue
            last = self._merge(piece)
            if last is not None:
                k = self.ids[piece]
                self.parts[k] = last
                self.made[k] = max(self.rank[piece], self.made[last[0]], self.made[last[1]])
        self.joins = {(a, b): self.rank[self.pieces[k]] for k, (a, b) in self.parts.items()}
        self.automaton = ahocorasick.Automaton()
        for k in self.made:
            self.automaton.add_word(self.pieces[k], (k, len(self.pieces[k])))
        self.automaton.make_automaton()
        self.pair_memo: dict[int, bool] = {}
        self.memo = WordMemo(lambda words: map(self.encode_run, words), words)

    def _merge(self, piece: str) -> tuple[int, int] | None:
        """The last two parts when the merges of ``piece`` end in ``piece`` itself, else None."""
        parts = list(piece)
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == np.inf:
                return None
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        ids = [self.ids.get(p) for p in parts]
        return (ids[0], ids[1]) if len(ids) == 2 and None not in ids else None

    def compatible(self, left: int, right: int) -> bool:
        """True if the merges of the joined text leave the two tokens as they are.

        Follows the tokens that lie on either side of the seam backwards in
        time; a merge across the seam that comes before the next merge on
        either side would have been made.
        """
        key = left << 32 | right
        known = self.pair_memo.get(key)
        if known is not None:
            return known
        a, b = left, right
        until_a = until_b = np.inf
        pieces, rank, made, parts = self.pieces, self.rank, self.made, self.parts
        fits = True
        while True:
            across = rank.get(pieces[a] + pieces[b])
            # the seam's merge is right of a's next merge and left of b's: at equal rank the left one goes first
            if across is not None and across < until_a and across <= until_b:
                fits = False
                break
            if a not in parts and b not in parts:
                break
            if made[a] >= made[b] if a in parts and b in parts else a in parts:
                until_a = min(until_a, made[a])
                a = parts[a][1]
            else:
                until_b = min(until_b, made[b])
                b = parts[b][0]
        if len(self.pair_memo) >= PAIRS:
            self.pair_memo.clear()
        self.pair_memo[key] = fits
        return fits

    def _known(self, run: str) -> list[int]:
        """Ids of a run of characters that the vocabulary has."""
        last = [0] * (len(run) + 1)
        memo, fits = self.pair_memo.get, self.compatible
        for end, (token, length) in self.automaton.iter(run):
            end += 1
            if last[end]:
                continue
            start = end - length
            if start:
                before = last[start]
                if not before:
                    continue
                ok = memo(before << 32 | token)
                if ok is None:
                    ok = fits(before, token)
                if not ok:
                    continue
            last[end] = token
        ids = []
        at = len(run)
        while at:
            token = last[at]
            ids.append(token)
            at -= len(self.pieces[token])
        ids.reverse()
        return ids

    def encode_run(self, run: str) -> tuple[int, ...]:
        """Ids of a run of normalised text: one table, cut only where a character is outside the vocabulary."""
        if self.chars.issuperset(run):
            return tuple(self._known(run))
        ids: list[int] = []
        held = 0
        for k, c in enumerate(run):
            if c not in self.chars:
                ids += self._known(run[held:k])
                ids += (self.bytes_from + b for b in c.encode("utf-8", "surrogatepass"))
                held = k + 1
        return tuple(ids + self._known(run[held:]))

    def words(self, text: str) -> list[str]:
        """The runs into which a text falls apart, in order; joined, they are the normalised text."""
        if not text:
            return []
        runs: list[str] = []
        text = MARK + text.replace(" ", MARK)
        for number, line in enumerate(text.split("\n") if self.lines else [text]):
            if number:
                runs.append("\n")
            if MARK * 2 in line or line.endswith(MARK):
                runs += re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line)
            else:
                first, *rest = line.split(MARK)
                if first:
                    runs.append(first)
                runs += [MARK + w for w in rest]
        return runs

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        for part in slices(texts):
            words = [self.words(t) for t in part]
            ids = self.memo.resolve(set().union(*words))
            for own in words:
                out: list[int] = []
                for w in own:
                    out += ids[w]
                yield out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: marks become spaces, the first one is dropped, byte runs are read as UTF-8 (a stray byte gives U+FFFD)."""
        ids = list(ids)
        high, end = self.bytes_from + 128, self.bytes_from + 256
        array = np.asarray(ids, np.int64)
        if not ((array >= high) & (array < end)).any():
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for k in ids:
                if self.bytes_from <= k < end:
                    run.append(k - self.bytes_from)
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(self.shown[k])
            out.append(_utf8(bytes(run)))
            text = "".join(out)
        return text.removeprefix(MARK).replace(MARK, " ")


def _utf8(run: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str, words: int = WORDS) -> PrefixTableCodec:
    """One codec for a worker, model file and size of the memo; every node has the file at this path."""
    return PrefixTableCodec(path, words)


def _ids_array(rows: list[list[int]]) -> pa.Array:
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    values = np.fromiter((k for r in rows for k in r), np.int32, int(lengths.sum()))
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(lengths)].astype(np.int32), values)


def encode(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id and ``ids`` (array of int). Null and empty texts have no ids; rows keep their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids_array([ids for _, part in text_parts(batch, "t") for ids in own.encode_many(part)])], names=["i", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(run, f"i {kind}, ids array<int>").withColumnRenamed("i", id_column)


def decode(df: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Each row's id and ``text`` of its ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = [own.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["i", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("i"), F.col(ids_column).alias("ids")).mapInArrow(run, f"i {kind}, text string").withColumnRenamed("i", id_column)


def round_trip(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """Encodes each text, decodes its ids, and gives a digest of both.

    Columns: id, n_tokens (long), ids_sha256 (lowercase hex of the decimal ids
    joined by commas), decoded_sha256 (lowercase hex of the decoded text in
    UTF-8), and with ``with_ids`` the ids (array of int). A null text counts as empty; repeated rows stay repeated; other
    columns are ignored; a null id is kept. An empty table gives an empty result.
    ``words`` bounds the memo of a worker, at about 600 bytes of memory for each;
    it changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, words)
        digits = [str(k) for k in range(len(own.pieces))].__getitem__
        sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
        for batch in batches:
            for done, part in text_parts(batch, "t"):
                found = list(own.encode_many(part))
                counts = np.fromiter(map(len, found), np.int64, len(found))
                digests = [sha(",".join(map(digits, ids))) for ids in found], [sha(own.decode(ids)) for ids in found]
                columns = [batch.column(0).slice(done, len(part)), pa.array(counts), *(pa.array(d, pa.string()) for d in digests)]
                yield pa.RecordBatch.from_arrays([*columns, *([_ids_array(found)] if with_ids else [])], names=names)

    names = ["i", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(run, f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("i", id_column)
