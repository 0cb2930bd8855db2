"""Accounting verdicts for a table of pairs, on fixture states that lie in one set of tables.

Pairs that differ by the names of parties alone are judged once (``alike``). Every
reference's needs make its fixture, and equal needs share one. The rows of
all fixtures and states lie in the seven ledger tables, each with a column that
names its state. References, candidates and mutants are rewritten to read one
state by an equality on that column, so the statements of all pairs and states
are answered together by shared scans (``execute``). What tells a mutant from its
reference, and the verdict, come from joins and groups over the table of
statements.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlens.operators.joins import even_left_join
from ledgerlens.plans import alike, execute, fixtures
from ledgerlens.plans.facts import LITERAL, SHAPES
from ledgerlens.plans.notes import Notes, ledger_notes
from ledgerlens.plans.sql import Node, SqlError, parse, render
from ledgerlens.sources.ledger import LEDGER
from ledgerlens.sources.scratch import forget, written

#: The column that names a row's fixture and state.
STATE = "_state"
#: Rows of fixtures that a task gives out together, at least.
_ROWS = 10_000


def in_state(sql: str, state: str) -> str:
    """A query over one state's rows of the tables: every table has an equality on the state's column, and a star names the columns that the tables had."""
    tree = parse(sql)
    names = {c.text.lower() for c in tree.walk("cte")}
    columns = {t: [c.split()[0] for c in ddl.split(", ")] for t, ddl in LEDGER.items()}

    def test(n: Node) -> Node:
        return Node("binary", "=", [Node("column", STATE, more={"table": n["alias"] or n.text}), Node("string", state)])

    def both(a: Node | None, b: Node) -> Node:
        return b if a is None else Node("binary", "AND", [Node("paren", items=[a]), b])

    def held(n: Node, outer: bool, tests: list[Node]) -> list[Node]:
        """The tables of a source; those that a join may leave empty take their tests in its condition, the others in ``tests``."""
        if n.kind == "join":
            kind = n.text.upper()
            if "RIGHT" in kind or "FULL" in kind:
                raise SqlError(f"{kind} over states")
            own = held(n.items[0], outer, tests)
            inside: list[Node] = []
            more = held(n.items[1], False, inside)
            if ("LEFT" in kind or outer) and inside:
                if n["using"] or "NATURAL" in kind:
                    raise SqlError(f"{kind} without a condition over states")
                for t in inside:
                    n.more["on"] = both(n["on"], t)
            else:
                tests += inside
            return own + more
        if n.kind == "grouped":
            return held(n.items[0], outer, tests)
        if n.kind == "table" and n.text.lower() not in names:
            tests.append(test(n))
            return [n]
        return []

    for n in list(tree.walk("select")):
        if not n["from"]:
            continue
        tests: list[Node] = []
        own = held(n["from"], False, tests)
        for t in tests:
            n.more["where"] = both(n["where"], t)
        items: list[Node] = []
        for i in n.items:
            tables = [t for t in own if not i.text or i.text.lower() in (t["alias"] or t.text).lower().split()] if i.kind == "star" else []
            known = next((k for t in tables for k in [t.text.lower()] if k not in columns), None) is None
            items += [Node("column", c, more={"table": t["alias"] or t.text}) for t in tables for c in columns[t.text.lower()]] if tables and known else [i]
        n.items[:] = items
    return render(tree)


#: What stands for a text's literals and for the state while a shape is learned.
_HOLE = re.compile("'\ue000(\\d+)\ue001'")


def placing() -> Callable[[str, str], str]:
    """``in_state`` for many texts: texts that differ by the literals of strings alone are read once."""
    seen: dict[str, list[str] | None] = {}

    def told(sql: str, state: str) -> str:
        parts, own = LITERAL.split(sql), [f"'{state}'"]
        for k in range(1, len(parts), 2):
            if parts[k][0] == "'":
                own.append(parts[k])
                parts[k] = "\x00"
        if "\x00" in sql or "\ue000" in sql or "'" in state:
            return in_state(sql, state)
        shape = "".join(parts)
        if shape not in seen:
            if len(seen) >= SHAPES:
                seen.clear()
            direct, words = in_state(sql, state), shape.split("\x00")
            made = _HOLE.split(in_state("".join(w + (f"'\ue000{k}\ue001'" if k < len(words) else "") for k, w in enumerate(words, 1)), "\ue0000\ue001"))
            known = "\ue000" not in "".join(made[::2]) and direct == "".join(own[int(x)] if k % 2 else x for k, x in enumerate(made))
            seen[shape] = made if known else None
            return direct
        made = seen[shape]
        return in_state(sql, state) if made is None else "".join([own[int(x)] if k % 2 else x for k, x in enumerate(made)])

    return told


def _arrow(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    shape = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(shape)], schema=shape)


_PLAN = (
    "pair string, gold string, made string, applicable array<string>, reasons array<string>, needs string, fixture string, missing boolean, counts boolean, unseeded array<string>, "
    "statements array<struct<kind: string, template: string, family: string, sql: string>>"
)


def planned(pairs: DataFrame, notes: Notes | None = None, as_of: str = fixtures.AS_OF) -> DataFrame:
    """For every pair (pair, gold_sql, generated_sql): its templates, its fixture's needs and its statements; made in tasks."""

    notes = notes or ledger_notes()

    def plan(pair: str, gold: str, made: str) -> tuple:
        evidence = fixtures.evidence_of(gold, notes)
        if evidence.error or evidence.unsupported:
            return pair, gold, made, [], ["unsupported_sql_feature"], None, None, False, False, [], []
        names = fixtures.applicable(evidence)
        if not names:
            return pair, gold, made, [], ["no_applicable_template"], None, None, False, False, [], []
        needs = fixtures.needs_of(evidence, as_of)
        text = json.dumps(needs, sort_keys=True)
        out, reasons = [("gold", None, None, gold), ("made", None, None, made)], []
        for name in names:
            wrong = [(f, t) for f, t, _ in fixtures.mutants(gold, name) if t]
            out += [("mutant", name, f, t) for f, t in wrong]
            reasons += [] if wrong else [f"mutant_generation_not_supported:{name}"]
        known = fixtures.known_literals(needs)
        absent = sorted(f"{c}: {v}" for c, own in fixtures.evidence_of(made, notes).literals.items() for v in own if v.lower() not in known)
        return pair, gold, made, names, reasons, text, hashlib.sha256(text.encode()).hexdigest()[:20], bool(needs["missing"]), bool(needs["counts"]), absent, out

    schema = StructType.fromDDL(_PLAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [plan(p, g or "", m or "") for p, g, m in zip(*(c.to_pylist() for c in batch.columns))]
            statements = [[dict(zip(("kind", "template", "family", "sql"), s)) for s in r[-1]] for r in rows]
            yield _arrow([(*r[:-1], s) for r, s in zip(rows, statements)], schema)

    return pairs.select(F.col("pair").cast("string"), F.col("gold_sql").alias("gold"), F.col("generated_sql").alias("made")).mapInArrow(run, schema)


def state_tables(plans: DataFrame) -> dict[str, DataFrame]:
    """The rows of all fixtures and states: the seven tables, each with the column of its state. Equal needs are made once, in tasks."""
    needs = plans.where(F.col("needs").isNotNull()).select("fixture", "needs").distinct()

    def rows_of(name: str, schema: StructType):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for batch in batches:
                for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    own = json.loads(text)
                    for state, entries in fixtures.STATES.items():
                        rows += [(*r, f"{key}:{state}") for r in fixtures.fixture_rows(own, entries)[name]]
                    if len(rows) >= _ROWS:
                        yield _arrow(rows, schema)
                        rows = []
            if rows:
                yield _arrow(rows, schema)

        return run

    out = {}
    for name, ddl in LEDGER.items():
        schema = StructType.fromDDL(f"{ddl}, {STATE} STRING")
        out[name] = needs.mapInArrow(rows_of(name, schema), schema)
    return out


def statements(plans: DataFrame) -> DataFrame:
    """Every statement of every pair in every state: pair, kind, template, family, state, sql."""
    listed = plans.select("pair", "fixture", F.explode("statements").alias("s")).select("pair", "fixture", "s.*")
    listed = listed.withColumn("state", F.explode(F.array(*map(F.lit, fixtures.STATES))))
    schema = StructType.fromDDL("pair string, kind string, template string, family string, state string, sql string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = placing()

        def turn(sql: str, state: str) -> str:
            try:
                return placed(sql, state)
            except SqlError:
                return sql  # fails in the same way where it is run

        for batch in batches:
            pair, fixture, kind, template, family, sql, state = (c.to_pylist() for c in batch.columns)
            yield _arrow(list(zip(pair, kind, template, family, state, (turn(q, f"{f}:{s}") for q, f, s in zip(sql, fixture, state)))), schema)

    return listed.select("pair", "fixture", "kind", "template", "family", "sql", "state").mapInArrow(run, schema)


def verdicts(spark: SparkSession, pairs: DataFrame, notes: Notes | None = None, as_of: str = fixtures.AS_OF, workers: int = execute.WORKERS) -> DataFrame:
    """A row for each pair (pair, gold_sql, generated_sql): eq_acct (1, 0, or null where nothing could be tested), applicable, tested and failed templates,
    reasons (why something was not tested, counted), states (each with the reason against it), mutants (each with the first state that tells it apart), failures, unseeded.

    Pairs that say the same but for names that are only compared are judged once; what is said of literals has each pair's own names.
    """
    notes = notes or ledger_notes()
    own = written(alike.renamed(pairs, notes), "pairs")
    texts = own.select("h", "gold", "made").distinct().repartition(3 * spark.sparkContext.defaultParallelism)
    found = judged(spark, texts.select(F.col("h").alias("pair"), F.col("gold").alias("gold_sql"), F.col("made").alias("generated_sql")), notes, as_of, workers)
    shown = even_left_join(own.select("h", F.col("pair").alias("_pair"), "names"), found.withColumnRenamed("pair", "h"), ["h"])
    out = written(shown.withColumns({"pair": F.col("_pair"), "unseeded": alike.own_names(F.col("unseeded"), F.col("names"))}).select(found.columns), "verdicts")
    forget(found)
    forget(own)
    return out


def judged(spark: SparkSession, pairs: DataFrame, notes: Notes | None = None, as_of: str = fixtures.AS_OF, workers: int = execute.WORKERS) -> DataFrame:
    """``verdicts`` with every pair judged by itself. ``pair`` names a row and must be unique."""
    plans = written(planned(pairs, notes, as_of), "plans")
    made = written(statements(plans), "statements")
    tables = {name: df.persist() for name, df in state_tables(plans).items()}
    engine = execute.Engine(spark, tables, as_of)
    try:
        outcomes, paths = execute.outcomes(engine, made.select(F.sha2("sql", 256).alias("h"), "sql").distinct(), workers)
        ran = written(made.withColumn("h", F.sha2("sql", 256)).join(outcomes, "h").select("pair", "kind", "template", "family", "state", "error", "n", "all_null", "preview", "in_order", "as_bag"), "ran")
    finally:
        engine.close()
        for df in tables.values():
            df.unpersist()
    forget(made)
    for path in paths:
        execute.remove(spark, path)
    out = written(_judged(plans, ran), "judged")
    forget(plans)
    forget(ran)
    return out


def _judged(plans: DataFrame, ran: DataFrame) -> DataFrame:
    c = F.col
    order = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(fixtures.STATES) for x in (s, k)]), c("state"))
    info = plans.select("pair", "missing", "counts", c("gold").rlike(execute._ORDERED).alias("is_ordered"))
    gold = ran.where("kind = 'gold'").join(info, "pair")
    why = (
        F.when(c("missing"), "unsupported_gold_requirement").when(c("error").isNotNull(), "gold_error").when(c("n") == 0, "gold_empty").when(c("all_null"), "gold_all_null")
        .when(c("counts") & c("preview").endswith('"rows": [[0]]}'), "gold_zero_count")
    )
    gold = gold.select("pair", "state", order.alias("place"), why.alias("reason"), F.when(c("is_ordered"), c("in_order")).otherwise(c("as_bag")).alias("gold_digest"), "is_ordered")
    states = gold.groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "state", "reason"))), lambda s: F.struct(s.state.alias("state"), s.reason.alias("reason"))).alias("states"))
    others = ran.where("kind <> 'gold'").join(gold.where("reason IS NULL").drop("reason"), ["pair", "state"])
    same = c("error").isNull() & (F.when(c("is_ordered"), c("in_order")).otherwise(c("as_bag")) == c("gold_digest"))
    others = others.withColumn("same", F.coalesce(same, F.lit(False)))
    killed = others.where("kind = 'mutant'").groupBy("pair", "template", "family").agg(F.min(F.when(c("error").isNull() & ~c("same"), F.struct("place", "state"))).alias("first"))
    mutants = killed.groupBy("pair").agg(
        F.array_sort(F.collect_list(F.struct("template", "family", c("first.state").alias("state")))).alias("mutants"),
        F.array_sort(F.collect_set(F.when(c("first").isNotNull(), c("template")))).alias("told"), F.array_sort(F.collect_set("template")).alias("mutated"),
    )
    late = F.when(c("error").startswith("query_timeout"), "timeout").when(c("error").isNotNull(), "generated_execution_error").otherwise("generated_mismatch")
    wrong = others.where("kind = 'made' AND NOT same").groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "state", late.alias("reason")))), lambda s: F.struct(s.state.alias("state"), s.reason.alias("reason"))).alias("wrong"))
    fit = gold.where("reason IS NULL").groupBy("pair").agg(F.lit(True).alias("fit"))
    joined = plans.select("pair", "applicable", "reasons", "unseeded").join(states, "pair", "left").join(mutants, "pair", "left").join(wrong, "pair", "left").join(fit, "pair", "left")
    none = lambda name: F.coalesce(c(name), F.array().cast("array<string>"))
    tested = F.filter("applicable", lambda t: F.coalesce(c("fit"), F.lit(False)) & F.array_contains(none("told"), t))
    failed = F.when(c("wrong").isNotNull(), tested).otherwise(F.array().cast("array<string>"))
    without = F.transform(F.filter("reasons", lambda r: r.contains(":")), lambda r: F.split_part(r, F.lit(":"), F.lit(2)))
    per_template = F.transform("applicable", lambda t: F.when(c("fit").isNull(), "no_valid_fixture_state").when(F.array_contains(without, t), "mutant_generation_not_supported").when(~F.array_contains(none("told"), t), "mutants_not_distinguished"))
    every = F.array_compact(F.concat(F.filter("reasons", lambda r: ~r.contains(":")), F.coalesce(F.transform("states", lambda s: s.reason), F.array().cast("array<string>")), per_template))
    counted = F.map_from_entries(F.transform(F.array_distinct(every), lambda r: F.struct(r, F.size(F.filter(every, lambda x: x == r)))))
    failures = F.flatten(F.transform(failed, lambda t: F.transform("wrong", lambda w: F.struct(t.alias("template"), w.state.alias("state"), w.reason.alias("reason")))))
    return joined.select(
        "pair", F.when(F.size(failed) > 0, 0).when(F.size(tested) > 0, 1).alias("eq_acct"), "applicable", tested.alias("tested"), failed.alias("failed"), counted.alias("reasons"), "states",
        F.filter("mutants", lambda m: c("fit").isNotNull()).alias("mutants"), failures.alias("failures"), "unseeded",
    )
