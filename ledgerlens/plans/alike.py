"""Pairs of queries that differ by the names of parties alone.

Where two queries only hold a name equal to a party's column, its spelling shows
in nothing that a verdict rests on: the fixture is seeded with the reference's own
names, no row has another column that holds them, and a condition is met by the
same rows whatever the name is. So the pair with its names replaced by others, in
the same order and as different from each other and from all else, has the same
verdict, and pairs that then have the same texts are judged once.

A name is left as it is, and its pair with it, wherever its spelling may show: if
a party's column stands anywhere else (in results, orders, patterns, functions),
if the name also stands elsewhere, is one that fixtures have of themselves or
differs from another by case or white space alone, or if a query is nested, reads
the tables of parties or cannot be read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans import fixtures
from ledgerlens.plans.facts import LITERAL, SHAPES
from ledgerlens.plans.notes import Notes
from ledgerlens.plans.sql import Node, SqlError, parse

#: Names of a pair that are replaced, at most: one digit keeps their order.
NAMES = 10
_OF = " of the pair"
#: Tables whose rows are numbered in the order of parties' names.
_PARTIES = {"customers", "vendors"}
#: Parts of a query of which none shows the spelling of a name that is only compared.
_KINDS = frozenset("select table join grouped alias column string number null boolean binary paren not is in like between case cast unary call star ordering now".split())


def _plain(text: str) -> str:
    return text.strip().lower()


def own_texts() -> set[str]:
    """Texts that fixtures and mutants have of themselves."""
    needs = fixtures.needs_of(fixtures.Evidence())
    cells = {x for entries in fixtures.STATES.values() for rows in fixtures.fixture_rows(needs, entries).values() for r in rows for x in r if isinstance(x, str)}
    swapped = {x for t in fixtures.TEMPLATES.values() for _, how, what in t.families if how == "literals" for kv in what.items() for x in kv}
    return {_plain(x) for x in (*cells, *swapped, *fixtures.ACCOUNT_CLASSES, *fixtures.TYPES, "expense", "paid", "--")}


def _party(n: Node) -> bool:
    return n.kind == "column" and n.text.lower() in fixtures._PARTY


def _held(sql: str, marks: list[str]) -> list[bool] | None:
    """For each string of a text, all of which are marks, whether it is a name that is only compared; None if names may show elsewhere."""
    try:
        tree = parse(sql)
    except SqlError:
        return None
    every = list(tree.walk())
    if tree.kind != "select" or sum(n.kind == "select" for n in every) > 1 or any(n.kind not in _KINDS or n["quoted"] or n["over"] or n["using"] for n in every):
        return None
    if any(i.kind == "star" for i in tree.items) or any(n.kind == "table" and n.text.lower() in _PARTIES or n.kind == "join" and "NATURAL" in n.text or n.kind == "alias" and n.text.lower() in fixtures._PARTY for n in every):
        return None
    if sorted(n.text for n in every if n.kind == "string") != sorted(marks):
        return None
    names: set[str] = set()
    fine: set[int] = set()
    for n in every:
        column, *rest = n.items or [None]
        if n.kind == "binary" and n.text in ("=", "!=") and column.kind == "string":
            column, rest = rest[0], [column]
        if not column or not _party(column):
            continue
        if (n.kind == "binary" and n.text in ("=", "!=") or n.kind == "in" and not n["query"]) and all(i.kind == "string" for i in rest):
            names |= {i.text for i in rest}
            fine.add(id(column))
        elif n.kind == "is" and rest[0].kind == "null":
            fine.add(id(column))
    return None if any(_party(n) and id(n) not in fine for n in every) else [m in names for m in marks]


def renaming(notes: Notes) -> Callable[[str, str], tuple[str, str, list[str]]]:
    """A function of a reference and a candidate: both with other names, and the names that were replaced. What a shape of two texts allows is worked out once."""
    own = own_texts()
    seen: dict[tuple[str, str], list[bool] | None] = {}

    def learned(parts: list[list[str]], places: list[list[int]]) -> list[bool] | None:
        out: list[bool] = []
        texts = []
        for words, at in zip(parts, places):
            marks = [f"\ue000{k}\ue001" for k in range(len(at))]
            words = list(words)
            for k, m in zip(at, marks):
                words[k] = f"'{m}'"
            texts.append("".join(words))
            held = _held(texts[-1], marks)
            if held is None:
                return None
            out += held
        # a party's column that notes take for a date
        return None if any(column in fixtures._PARTY for column, _, _ in fixtures.evidence_of(texts[0], notes).dates) else out

    def told(gold: str, made: str) -> tuple[str, str, list[str]]:
        same = gold, made, []
        if any(x in t for t in (gold, made) for x in ("\x00", "\ue000", _OF)):
            return same
        parts = [LITERAL.split(t) for t in (gold, made)]
        if any(words[k][0] in '"`[' for words in parts for k in range(1, len(words), 2)):
            return same
        places = [[k for k in range(1, len(words), 2) if words[k][0] == "'"] for words in parts]
        literals = [words[k] for words, at in zip(parts, places) for k in at]
        if not literals:
            return same
        for words, at in zip(parts, places):
            for k in at:
                words[k] = "\x00"
        shape = "".join(parts[0]), "".join(parts[1])
        if shape not in seen:
            if len(seen) >= SHAPES:
                seen.clear()
            seen[shape] = learned(parts, places)
        held = seen[shape]
        if not held or not any(held):
            return same
        values = [x[1:-1].replace("''", "'") for x in literals]
        names = sorted({v for v, h in zip(values, held) if h})
        plain = {_plain(v) for v in names}
        if len(names) > NAMES or len(plain) < len(names) or "" in plain or plain & own or any(p.startswith("seed ") for p in plain) or plain & {_plain(v) for v, h in zip(values, held) if not h}:
            return same
        shown = {v: f"'name {k}{_OF}'" for k, v in enumerate(names)}
        words = iter([shown[v] if h else x for v, x, h in zip(values, literals, held)])
        for own_parts, at in zip(parts, places):
            for k in at:
                own_parts[k] = next(words)
        return "".join(parts[0]), "".join(parts[1]), names

    return told


def renamed(pairs: DataFrame, notes: Notes) -> DataFrame:
    """Every pair (pair, gold_sql, generated_sql) with its texts under other names (gold, made), the names replaced, and a digest of both texts (h); made in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = renaming(notes)
        for batch in batches:
            found = [told(g or "", m or "") for g, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kinds = pa.string(), pa.string(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]], names=["pair", "gold", "made", "names"])

    rows = pairs.select(F.col("pair").cast("string"), F.col("gold_sql").cast("string"), F.col("generated_sql").cast("string"))
    rows = rows.mapInArrow(run, "pair string, gold string, made string, names array<string>")
    return rows.withColumn("h", F.sha2(F.concat(F.length("gold").cast("string"), F.lit(" "), "gold", "made"), 256))


def own_names(texts: Column, names: Column) -> Column:
    """Texts that end with a replaced name, with the name itself."""
    ends = f"^(.*: )name ([0-9]){_OF}$"
    name = lambda t: F.element_at(names, F.regexp_extract(t, ends, 2).try_cast("int") + 1)
    return F.when(F.size(names) > 0, F.transform(texts, lambda t: F.when(t.rlike(ends), F.concat(F.regexp_extract(t, ends, 1), name(t))).otherwise(t))).otherwise(texts)
