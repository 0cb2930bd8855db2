"""Conversations with a language model, many rows at a time.

A row's part in a conversation is a generator: it yields a prompt and is sent
the answer. All rows of a batch are moved along together, so the model is asked
for many answers at once, whatever step each row is at.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

Talk = Generator[str, str, Any]
#: Prompts of one call of the model.
BATCH = 32


class Truncated(Exception):
    """An answer that ended at the model's limit. A model gives it in an answer's place, or raises it."""


class Failed(Exception):
    """A call of the model that gave no answer."""


def _ask(answer: Callable[[list[str]], list], prompts: list[str]) -> list:
    """Answers, or what went wrong, for each prompt; a call that fails is tried prompt by prompt."""
    try:
        found = list(answer(prompts))
        if len(found) != len(prompts):
            raise Failed(f"{len(found)} answers to {len(prompts)} prompts")
        return found
    except Exception as e:  # noqa: BLE001 - the model is foreign; its failure is an answer
        if len(prompts) > 1:
            return [_ask(answer, [p])[0] for p in prompts]
        return [e if isinstance(e, Truncated) else Failed(str(e))]


def talk_all(talks: list[Talk], answer: Callable[[list[str]], list], batch: int = BATCH) -> list:
    """Results of all generators, in order."""
    results: list = [None] * len(talks)
    open_: list[tuple[int, str]] = []

    def step(k: int, move: Callable[[], str], later: list) -> None:
        try:
            later.append((k, move()))
        except StopIteration as end:
            results[k] = end.value

    for k, talk in enumerate(talks):
        step(k, lambda: next(talk), open_)  # noqa: B023
    while open_:
        later: list[tuple[int, str]] = []
        for s in range(0, len(open_), batch):
            part = open_[s : s + batch]
            for (k, _), said in zip(part, _ask(answer, [p for _, p in part])):
                talk = talks[k]
                step(k, (lambda: talk.throw(said)) if isinstance(said, Exception) else (lambda: talk.send(said)), later)  # noqa: B023
        open_ = later
    return results


def in_rounds(df: DataFrame, talk: Callable[[dict], Talk], answer: Callable[[list[str]], list], added: str, batch: int = BATCH) -> DataFrame:
    """``df`` with the columns of the schema ``added``, which each row's talk gives as a dict.

    ``talk`` and ``answer`` go to the executors. Write the result before it is
    used twice, as a lost task asks its rows again.
    """
    schema = StructType([*df.schema.fields, *_parse_datatype_string(added).fields])
    arrow = to_arrow_schema(schema)
    names = _parse_datatype_string(added).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = talk_all([talk(r) for r in part.to_pylist()], answer, batch)
            columns = [pa.array([f.get(n) for f in found], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema=pa.schema([*part.schema, *(arrow.field(n) for n in names)]))

    return df.mapInArrow(run, schema)
