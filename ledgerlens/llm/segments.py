"""Texts cut where no tokenizer of words looks across, and a bounded memo of what each distinct segment gives.

A segment begins at a space or line feed that follows a character that is
certainly no white space, and reaches to the next one; the first begins with
the text. Byte-level pair encoding with the usual word pattern, and merges of
pieces that hold a word mark in front only, never join or look across such a
place, so a text's tokens are those of its segments, one after the other.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerlens.llm.common import give_back
from ledgerlens.llm.token_files import WIDEST, WordTable, _runs, first_of_each

#: Bytes of texts that a worker cuts at once; a longer text is a part of its own.
PART = 4 << 20


def text_bytes(batch: pa.RecordBatch, column: str, part: int = PART) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of an Arrow batch in runs of about ``part`` bytes: the first row, the texts' bytes one after the other, and each text's size; null counts as empty."""
    own = batch.column(batch.schema.get_field_index(column))
    if own.null_count:
        own = own.fill_null("")
    own = own.cast(pa.large_string())
    ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    raw = np.frombuffer(own.buffers()[2], np.uint8) if len(own) and own.buffers()[2] is not None else np.empty(0, np.uint8)
    begin = 0
    while begin < len(own):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + part, "right")) - 1)
        yield begin, raw[ends[begin] : ends[end]], np.diff(ends[begin : end + 1])
        begin = end
    give_back()


def cut(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts that lie one after the other: where each begins, its size, and how many each text has."""
    place = np.zeros(len(raw), bool)
    if len(raw) > 1:
        before, own = raw[:-1], raw[1:]
        place[1:] = ((own == 32) | (own == 10)) & (before > 32) & (before < 127)
        # behind a character of two to four bytes: only of ranges that hold no white space at all
        wide = np.flatnonzero(((own == 32) | (own == 10)) & (before >= 128)) + 1
        lead = raw[np.maximum(wide - 2, 0)], raw[np.maximum(wide - 3, 0)], raw[np.maximum(wide - 4, 0)]
        place[wide] = (lead[0] >= 0xC3) & (lead[0] <= 0xDF) | (lead[1] >= 0xE4) & (lead[1] <= 0xED) | (lead[2] >= 0xF0)
    stops = np.cumsum(sizes)
    starts = (stops - sizes)[sizes > 0]
    place[starts] = True
    begins = np.flatnonzero(place)
    counts = np.diff(np.searchsorted(begins, stops), prepend=0)
    return begins, np.diff(np.r_[begins, len(raw)]), counts


class SegmentMemo:
    """Entry numbers of segments in a store.

    ``store.add(segments)`` takes new segments as strings, each once, and enters
    them in order; ``store.clear()`` empties it; ``store.full()`` says when that
    is due. Numbers hold until the next call.
    """

    def __init__(self, store, words: int):
        self.store, self.words = store, words
        self.clear()

    def clear(self, words: int = 0) -> None:
        self.store.clear()
        self.table = WordTable(max(self.words, words))
        self.entry = np.empty(self.table.limit, np.int64)
        self.count = 0

    def numbers(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each segment's entry. Segments of over ``WIDEST`` bytes are entered, but not looked up again."""
        if self.table.limit > self.words or self.store.full():
            self.clear()
        padded = np.concatenate([raw, np.zeros(32, np.uint8)])
        short = np.flatnonzero(sizes <= WIDEST)
        key = WordTable.key(padded, begins[short], sizes[short])
        mixed = WordTable.mixed(key)
        found = self.table.find(key, mixed)
        missing = np.flatnonzero(found < 0)
        first, number = first_of_each(key[:, missing], mixed[missing])
        if self.table.count + len(first) > self.table.limit:
            found[:] = -1
            missing = np.arange(len(short))
            first, number = first_of_each(key, mixed)
            self.clear(len(first))  # a text with more segments than the memo holds has a larger one for itself
        out = np.empty(len(begins), np.int64)
        fresh = missing[first]
        wide = np.flatnonzero(sizes > WIDEST)
        spans = np.concatenate([short[fresh], wide])
        text = padded.tobytes()
        self.store.add([text[a:b].decode("utf-8") for a, b in zip(begins[spans].tolist(), (begins[spans] + sizes[spans]).tolist())])
        entered = np.arange(self.count, self.count + len(spans))
        self.count += len(spans)
        new = self.table.enter(key[:, fresh], mixed[fresh])
        self.entry[new] = entered[: len(fresh)]
        found[missing] = new[number]
        out[short] = self.entry[found]
        out[wide] = entered[len(fresh) :]
        return out


class Ragged:
    """Rows of different length, entered once, in one growing array."""

    def __init__(self, kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.values, self.used = np.empty(1 << 16, self.kind), 0
        self.at, self.size, self.count = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        grown = np.empty(max(2 * len(array), used + more), array.dtype)
        grown[:used] = array[:used]
        return grown

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = self._room(self.values, self.used, len(values))
        self.at, self.size = self._room(self.at, self.count, len(sizes)), self._room(self.size, self.count, len(sizes))
        self.values[self.used : self.used + len(values)] = values
        self.at[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + len(sizes)] = sizes
        self.used += len(values)
        self.count += len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of rows, one row after the other, and each row's length."""
        sizes = self.size[rows]
        return self.values[_runs(self.at[rows], sizes)], sizes


#: Segments of these characters alone have the same classes in every edition of Unicode that a library may hold.
_SETTLED = re.compile("[\t\n\r -~\u00a1-\u024f]*").fullmatch
#: The usual word pattern, with NUL as a word and an end of text by itself.
_WORDS = r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s+(?![^\s\x00])|\s+"


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of every token of a byte-level vocabulary, by id; refuses a file whose ids do not follow its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    tokens = [b""] * len(model["vocab"])
    for token, k in model["vocab"].items():
        tokens[k] = bytes(letter[c] for c in token)
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if len(tokens) != 256 + len(made) or sorted(tokens[:256]) != [bytes([b]) for b in range(256)] or any(model["vocab"][m] != 256 + k for k, m in enumerate(made)):
        raise ValueError(f"{path}: ids do not follow the merges")
    return tokens


class ByteEncoder:
    """Ids of segments as the tokenizers library gives them for the byte-level file at ``path``.

    With ``plain`` the strings of special tokens are ordinary text. Segments go
    through a library many at a time, kept apart by a NUL. Those of settled
    characters go through tiktoken over the file's own vocabulary, which gives
    the same ids in a fifth of the time; all others through tokenizers, those
    with a NUL one by one. Refuses a file that changes texts or cuts them by
    another rule than the usual word pattern.
    """

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.apart = Tokenizer.from_file(path), Tokenizer.from_file(path)
        made = json.loads(self.whole.to_str())
        cutter = made["pre_tokenizer"] or {}
        if made["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex") or made["post_processor"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        self.apart.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\0", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)])
        self.whole.encode_special_tokens = self.apart.encode_special_tokens = plain
        self.tokens = byte_tokens(path)
        self.mark = self.tokens.index(b"\0")
        self.fast = tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks={t: k for k, t in enumerate(self.tokens)}, special_tokens={})
        special = [] if plain else [re.escape(t["content"]) for t in made["added_tokens"]]
        self.special = re.compile("|".join(special)).search if special else lambda segment: None

    def __call__(self, segments: list[str], call: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments, one segment after the other, and how many each has."""
        kinds = np.fromiter((0 if _SETTLED(s) and not self.special(s) else 2 if "\0" in s else 1 for s in segments), np.int8, len(segments))
        sizes = np.zeros(len(segments), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for kind, joined in ((0, lambda t: self.fast.encode_to_numpy(t)), (1, lambda t: np.array(self.apart.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.int32))):
            which = np.flatnonzero(kinds == kind)
            for k in range(0, len(which), call):
                own = which[k : k + call]
                ids = joined("\0".join([segments[n] for n in own.tolist()])).astype(np.int32)
                stops = np.flatnonzero(ids == self.mark)
                if len(stops) != len(own) - 1:
                    raise RuntimeError("the marks between segments were changed")
                sizes[own] = np.diff(np.r_[-1, stops, len(ids)]) - 1
                found.append((own, np.delete(ids, stops)))
        for n in np.flatnonzero(kinds == 2).tolist():
            ids = np.array(self.whole.encode(segments[n], add_special_tokens=False).ids, np.int32)
            sizes[n] = len(ids)
            found.append((np.array([n]), ids))
        out = np.empty(int(sizes.sum()), np.int32)
        begins = np.cumsum(sizes) - sizes
        for own, ids in found:
            out[_runs(begins[own], sizes[own])] = ids
        return out, sizes
