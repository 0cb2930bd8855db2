"""A bounded memo from words to token ids, kept by each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

#: Words of one generation; a worker holds two generations at most.
WORDS = 150_000
#: Characters of texts that are split into words at once.
SLICE = 1 << 20


class WordMemo:
    """Looks words up in two generations of answers; the older one is forgotten when the younger is full."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[tuple[int, ...]]], words: int = WORDS):
        self.encode_many, self.words = encode_many, words
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def resolve(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """A dict that holds the ids of all of ``words``."""
        if len(self.young) > self.words:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for word in words.difference(young):
            ids = old.get(word)
            if ids is None:
                missing.append(word)
            else:
                young[word] = ids
        young.update(zip(missing, self.encode_many(missing)))
        return young


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``SLICE`` characters; a longer text is a run of its own."""
    run: list[str] = []
    held = 0
    for text in texts:
        if run and held + len(text) > SLICE:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run
