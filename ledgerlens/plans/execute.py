"""Guarded execution of query pairs and comparison of their results.

Every distinct text runs once, over tables that are kept while the run lasts.
Texts are read in tasks: what cannot run has its error there, and aggregates
over one source share scans (``fuse``). Texts of one shape, which differ by the
literals that columns equal, are joined with the groups of their scan and leave
their outcomes in the cluster, so the driver sees a shape and not its texts.

Shapes of few texts and queries of their own run through ``spark.sql`` one by one
or in shared scans whose groups the driver takes; if a shared scan fails, its
halves run, down to a query by itself, so that each has its own error. A bounded
pool of threads keeps several jobs in flight, each under a tag that a timer
cancels.

Every result leaves its number of rows, whether all its cells are null, and two
digests behind, of its rows in order and as a bag. Of a result of up to ``KEPT``
rows the driver takes them; a larger one is written once and they are taken in
the cluster. Pairs are judged by these in one job over the table of pairs.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import re
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.dataflow import canonical, numbered, result_digest
from ledgerlens.operators.metrics import group_of
from ledgerlens.plans import fuse
from ledgerlens.plans.dialect import DialectError, to_spark
from ledgerlens.plans.sql import Node, SqlError, parse
from ledgerlens.sources.ledger import D
from ledgerlens.sources.scratch import forget, fresh_path, remove, written

WORKERS = 8
TIMEOUT = 120.0
#: Rows of a result that the driver looks at, and of those that a preview shows.
KEPT, SHOWN = 10_000, 100
#: Groups of a shared scan that the driver holds, at most.
GROUPS = 50_000
#: Queries that are planned together, whose outcomes the driver holds before they are written out.
HELD = 60_000
#: Texts from which on a shape is answered in the cluster.
MANY = 50
_ORDERED = r"(?i)\border\s+by\b"

# What makes a pair ambiguous.
FLAGS = ("gold_sql_error", "generated_sql_error", "both_results_empty", "gold_result_empty", "generated_result_empty", "gold_result_all_null", "generated_result_all_null")


def ordered(sql: str) -> bool:
    """Whether a reference query asks for an order, anywhere in its text."""
    return bool(re.search(_ORDERED, sql))


def spread(df: DataFrame) -> DataFrame:
    """A table that many queries will scan: one that comes in fewer parts than there are cores is dealt out once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@dataclass(frozen=True)
class Reader:
    """What is known of an engine's tables where there is no session."""

    as_of: str
    tables: frozenset[str]
    types: dict[str, str]
    strings: set[str]

    def absent(self, tree: Node) -> str | None:
        """The first table of a query that is not there."""
        known = {t.lower() for t in self.tables} | {c.text.lower() for c in tree.walk("cte")}
        return next((n.text for n in tree.walk("table") if n.text.lower() not in known), None)

    def turned(self, sql: str | None) -> tuple[str | None, str | None]:
        """The query in Spark SQL, or an error that shows without running it."""
        if not (sql or "").strip():
            return None, "empty SQL"
        try:
            tree = parse(sql)
            if absent := self.absent(tree):
                return None, f"no such table: {absent}"
            # a name that no table has and that the text gives to nothing
            known = {*self.types, *(n.text.lower() for n in tree.walk("alias")), *(c.lower() for n in tree.walk("cte") for c in n["columns"] or ())}
            if absent := next((n.text for n in tree.walk("column") if not n["quoted"] and n.text.lower() not in known), None):
                return None, f"no such column: {absent}"
            return to_spark(sql, self.as_of, self.types), None
        except (DialectError, SqlError) as e:
            return None, str(e)
        except Exception as e:  # noqa: BLE001 - a query's failure is a result here
            return None, _said(e)

    def read(self, texts: DataFrame) -> DataFrame:
        """Of every text (h, sql): its error, if it has one without running, or its shape and literals, if it is one of a shape; made in tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told, kinds = fuse.sharing(self.as_of, self.types, self.strings), {}
            for batch in batches:
                rows = []
                for sql in batch.column(1).to_pylist():
                    part = told(sql)
                    if part is None or part.keys or not part.held:
                        rows.append((self.turned(sql)[1] if part is None else None, None, None, None))
                        continue
                    spec = fuse.spec(part)
                    if spec not in kinds:
                        if len(kinds) >= fuse.SHAPES:
                            kinds.clear()
                        absent = self.absent(parse(sql))  # one source, and no tables beside it: all texts of the shape fail alike
                        kinds[spec] = hashlib.sha256(spec.encode("utf-8", "surrogatepass")).hexdigest()[:32], absent and f"no such table: {absent}"
                    shape, error = kinds[spec]
                    rows.append((error, None, None, None) if error else (None, shape, spec, list(part.literals)))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["h", "sql", "error", "shape", "spec", "literals"])

        return texts.select("h", "sql").mapInArrow(run, "h string, sql string, error string, shape string, spec string, literals array<string>")


class Engine:
    """A session for SQLite queries over named tables: errors in values give nulls, as in SQLite."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], as_of: str, timeout: float = TIMEOUT, kept: int = KEPT):
        self.spark, self.as_of, self.timeout, self.kept = spark, as_of, timeout, kept
        self.tables = tables
        self.session = spark.newSession()
        for key, value in (("spark.sql.ansi.enabled", "false"), ("spark.sql.session.timeZone", "UTC")):
            self.session.conf.set(key, value)
        kinds = {"long": "int", "integer": "int", "short": "int", "byte": "int", "double": "real", "float": "real"}
        self.types = {f.name.lower(): kinds.get(f.dataType.typeName(), "text") for df in tables.values() for f in df.schema}
        kinds_of: dict[str, set[str]] = defaultdict(set)
        for f in (f for df in tables.values() for f in df.schema):
            kinds_of[f.name.lower()].add(f.dataType.simpleString())
        #: Columns that hold strings in every table that has them.
        self.strings = {c for c, own in kinds_of.items() if own == {"string"}}
        self.reader = Reader(as_of, frozenset(tables), self.types, self.strings)
        mark = uuid.uuid4().hex[:12]
        self.names = {name: f"{name}_{mark}" for name in tables}
        for name, df in tables.items():
            df.createOrReplaceGlobalTempView(self.names[name])
            self.session.sql(f"CREATE OR REPLACE TEMP VIEW `{name}` AS SELECT * FROM global_temp.`{self.names[name]}`")

    def close(self) -> None:
        for name in self.names.values():
            self.spark.catalog.dropGlobalTempView(name)

    def query(self, sql: str | None) -> tuple[DataFrame | None, str | None]:
        """The query's result, not yet computed, or an error."""
        text, error = self.reader.turned(sql)
        if error is not None:
            return None, error
        try:
            return self.session.sql(text), None
        except Exception as e:  # noqa: BLE001 - a query's failure is a result here
            return None, _said(e)

    @contextmanager
    def limited(self, queries: int = 1):
        """Cancels this thread's jobs when the time of so many queries is over, and again while more of them start."""
        tag, context, done = f"query-{uuid.uuid4().hex}", self.spark.sparkContext, threading.Event()
        context.addJobTag(tag)

        def watch() -> None:
            wait = min(self.timeout * queries, threading.TIMEOUT_MAX)
            while not done.wait(wait):
                context.cancelJobsWithTag(tag)
                wait = 0.5

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            done.set()
            watcher.join()
            context.removeJobTag(tag)

    def run(self, sql: str | None) -> tuple:
        """Outcome of one query: error, rows, all_null, preview, ordered digest, bag digest, seconds."""
        began = time.monotonic()
        frame, error = self.query(sql)
        return (error, *[None] * 5, round(time.monotonic() - began, 4)) if frame is None else self.outcome(frame, began)

    def outcome(self, frame: DataFrame, began: float) -> tuple:
        """Outcome of a result that is not yet computed."""
        try:
            with self.limited():
                rows = frame.limit(self.kept + 1).collect()
                found = _small(rows) if len(rows) <= self.kept else _large(frame)
            error = None
        except Exception as e:  # noqa: BLE001
            late = time.monotonic() - began >= self.timeout or "cancelled" in str(e).lower()
            found, error = [None] * 5, f"query_timeout: over {self.timeout:g} seconds" if late else _said(e)
        return (error, *found, round(time.monotonic() - began, 4))

    def run_scan(self, scan: fuse.Scan) -> list[tuple[str, tuple]]:
        """Outcomes of the queries of a shared scan, each with its text."""
        if len(scan.parts) == 1 or not self.kept:
            return [(p.sql, self.run(p.sql)) for p in scan.parts]
        began = time.monotonic()
        if absent := self.reader.absent(parse(scan.parts[0].sql)):  # one source, and no tables beside it: all fail alike
            return [(p.sql, (f"no such table: {absent}", *[None] * 5, round(time.monotonic() - began, 4))) for p in scan.parts]
        text, shapes = scan.text()
        name = f"groups_{uuid.uuid4().hex[:12]}"
        most = max(self.kept, GROUPS)
        try:
            with self.limited():
                groups = self.session.sql(text)
                rows = groups.limit(most + 1).collect()
        except Exception:  # noqa: BLE001 - the halves say which query it is
            return [o for half in scan.halves() for o in self.run_scan(half)]
        if len(rows) > most and scan.held:
            return [o for half in scan.halves() for o in self.run_scan(half)]
        held = self.session.createDataFrame(rows, groups.schema) if len(rows) <= most else written(groups, "groups")
        held.createOrReplaceTempView(name)
        share = (time.monotonic() - began) / len(scan.parts)
        try:
            if scan.held:
                return [o for shape in shapes for o in self._by_literals(shape, scan, name, groups.schema, share)]
            if not scan.keys:
                # one row for all: every query's own row is projected from it in one job
                return self._one_row(shapes, name, share)
            out = []
            for shape in shapes:
                started = time.monotonic()
                cut = ("" if shape.limit is None else f" LIMIT {shape.limit}") + (f" OFFSET {shape.offset}" if shape.offset else "")
                try:
                    frame = self.session.sql(f"SELECT {shape.items} FROM `{name}`{shape.tail}{cut}")
                except Exception:  # noqa: BLE001
                    out += [(p.sql, self.run(p.sql)) for p in shape.parts]
                    continue
                *found, seconds = self.outcome(frame, started)
                out += [(p.sql, (*found, round(seconds + share, 4))) for p in shape.parts]
            return out
        finally:
            self.session.catalog.dropTempView(name)
            forget(held)

    def _by_literals(self, shape: fuse.Shape, scan: fuse.Scan, name: str, schema, share: float) -> list[tuple[str, tuple]]:
        """Queries of one shape: their rows are those of their literals; aggregates without keys have a row even over nothing."""
        width = len(scan.held)
        own: dict[tuple, list[tuple]] = defaultdict(list)
        nothing: list[tuple] = []
        try:
            with self.limited():
                for row in self.session.sql(f"SELECT {', '.join(f'l{k}' for k in range(width))}, {shape.items} FROM `{name}`{shape.tail}").collect():  # at most ``GROUPS`` rows
                    own[tuple(row[:width])].append(tuple(row[width:]))
                if not scan.keys:
                    empty = [f"CAST({'0' if _counts(a) else 'NULL'} AS {schema[f'a{k}'].dataType.simpleString()}) AS a{k}" for k, a in enumerate(_names(scan))]
                    nothing = [tuple(r) for r in self.session.sql(f"SELECT {shape.items} FROM (SELECT {', '.join(empty)})").collect()]
        except Exception:  # noqa: BLE001
            return [(p.sql, self.run(p.sql)) for p in shape.parts]
        out = []
        for p in shape.parts:
            rows = shape.rows(own[p.literals] if p.literals in own else nothing)
            out.append((p.sql, (None, *_small(rows), round(share, 4)) if len(rows) <= self.kept else self.run(p.sql)))
        return out

    def _one_row(self, shapes: list[fuse.Shape], name: str, share: float) -> list[tuple[str, tuple]]:
        structs = [f"struct({s.items}) AS q{k}" for k, s in enumerate(shapes)]
        try:
            with self.limited():
                row = self.session.sql(f"SELECT {', '.join(structs)} FROM `{name}`").collect()[0]
        except Exception:  # noqa: BLE001
            return [(p.sql, self.run(p.sql)) for s in shapes for p in s.parts]
        return [(p.sql, (None, *_small([tuple(r)]), round(share, 4))) for s, r in zip(shapes, row) for p in s.parts]


    def answered(self, shapes: list[tuple[str, fuse.Shared, int]], read: str) -> list[tuple[str, float, list[str]]]:
        """Outcomes of all texts of some shapes (key, part, number of texts) that share a scan, made in the cluster: where they are written, seconds of each, and the shapes.

        ``read`` is where the texts are. A shape that fails, or gives what tasks do not hold as the driver does, is left out.
        """
        began = time.monotonic()
        scan = fuse.Scan(shapes[0][1].source, (), shapes[0][1].held, [p for _, p, _ in shapes])
        try:
            groups, fields = self.session.sql(scan.text(whole=True)[0]), []
            places = {a: f"a{k}" for k, a in enumerate(_names(scan))}
            # aggregates over nothing, where a text's literals have no group
            filled = [F.expr(f"coalesce({c}, CAST({'0' if _counts(a) else 'NULL'} AS {groups.schema[c].dataType.simpleString()}))").alias(c) for a, c in places.items()]
            for number, (_, part, _) in enumerate(shapes):
                items = part.items.format(*[places[a] for a in part.aggregates], n="")
                kinds = [f.dataType.simpleString() for f in groups.selectExpr(f"struct({items}) AS q").schema["q"].dataType]
                if not all(k.startswith("decimal") or k in _ALIKE for k in kinds):
                    raise TypeError(f"{kinds} in tasks")
                kind = ", ".join(f"c{n}: {'string' if k == 'void' else k}" for n, k in enumerate(kinds))
                fields.append(f"CASE WHEN `_k` = {number} THEN CAST(struct({items}) AS STRUCT<{kind}>) END AS q{number}")
            numbers = F.broadcast(self.session.createDataFrame([(key, number) for number, (key, _, _) in enumerate(shapes)], "shape string, `_k` int"))
            texts = self.session.read.parquet(read).join(numbers, "shape").select(F.col("h").alias("_h"), "_k", *[F.col("literals")[k].alias(f"_l{k}") for k in range(len(scan.held))])
            on = [F.col(f"_l{k}") == F.col(f"l{k}") for k in range(len(scan.held))]
            rows = texts.join(groups, on, "left").select("_h", "_k", *filled).selectExpr("_h", "_k", *fields)
            total = sum(n for _, _, n in shapes)
            with self.limited(total):
                out = written(rows.mapInArrow(_one_row_each, f"h string, {_OUTCOME}"), "answered")
            return [(out._written_at, round((time.monotonic() - began) / total, 4), [key for key, _, _ in shapes])]
        except Exception:  # noqa: BLE001 - the halves say which shape it is
            middle = len(shapes) // 2
            return [o for half in (shapes[:middle], shapes[middle:]) if half and middle for o in self.answered(half, read)]


def _one_row_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of texts (first column) whose one row is in the column of their shape's number (second)."""
    names = [x.split()[0] for x in f"h string, {_OUTCOME}".split(", ")]
    for batch in batches:
        numbers, rows = batch.column(1).to_numpy(), [None] * batch.num_rows
        for number in set(numbers.tolist()):
            at = (numbers == number).nonzero()[0]
            for k, row in zip(at.tolist(), batch.column(2 + number).take(pa.array(at)).to_pylist()):
                rows[k] = _small([tuple(row.values())])
        kinds = (pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(len(rows), pa.string()), *columns, pa.nulls(len(rows), pa.float64())], names=names)


#: Types of which tasks see the same values as the driver.
_ALIKE = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "void")


def _names(scan: fuse.Scan) -> list[str]:
    """The aggregates of a scan in the order of its columns."""
    return list(dict.fromkeys(a for p in scan.parts for a in p.aggregates))


def _counts(aggregate: str) -> bool:
    """Whether an aggregate over nothing is zero."""
    return aggregate.lower().startswith(("count(", "coalesce(sum("))


def _said(error: Exception) -> str:
    return str(error).strip().splitlines()[0][:300]


def _small(rows: list) -> tuple:
    """Rows, all_null, preview and both digests of a result on the driver."""
    lines = [json.dumps([plain_cell(v) for v in r], ensure_ascii=False) for r in rows]
    empty = bool(rows) and all(v is None for r in rows for v in r)
    return len(rows), empty, _preview(rows, len(rows)), _digest(lines), _digest(sorted(lines))


def _preview(rows: list, count: int) -> str:
    return json.dumps({"row_count": count, "truncated": count > SHOWN, "rows": [[json_safe(v) for v in r] for r in rows[:SHOWN]]}, ensure_ascii=False)


def _large(frame: DataFrame) -> tuple:
    """The same of a result that is written once and looked at in the cluster."""
    placed = numbered(frame.toDF(*[f"c{n}" for n in range(len(frame.columns))]))
    names = [c for c in placed.columns if c != "at"]
    cells = placed.select("at", *[c.alias(n) for n, c in zip(names, canonical(placed.select(*names), columns=True))])
    found = cells.agg(F.count("*").alias("n"), F.bool_and(F.coalesce(*names).isNull()).alias("empty"), result_digest(*names).alias("bag"), result_digest("at", *names).alias("ordered")).first()
    first = placed.where(F.col("at") < SHOWN).orderBy("at").drop("at").collect()
    forget(placed)
    return found.n, found.empty, _preview(first, found.n), found.ordered, found.bag


def _digest(lines: list[str]) -> str:
    sha = hashlib.sha256()
    for line in lines:
        sha.update(line.encode("utf-8", "surrogatepass") + b"\n")
    return sha.hexdigest()


def plain_cell(value):
    """A value for comparison: doubles rounded to six decimals, whole ones as integers, truths as 0 and 1, dates as text."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        value = round(value, 6)
        return int(value) if value == value and abs(value) < 1e15 and value == int(value) else repr(value) if value != value or abs(value) == float("inf") else value
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    return json_safe(value)


def json_safe(value):
    """A result's value as JSON has it; bytes by their hex digits."""
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if isinstance(value, (bytes, bytearray)):
        return {"type": "bytes", "hex": bytes(value).hex()}
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    return str(value)


_OUTCOME = "error string, n long, all_null boolean, preview string, in_order string, as_bag string, seconds double"


def outcomes_of(engine: Engine, texts: Iterator[str], workers: int) -> tuple[DataFrame, str | None]:
    """A table of the outcomes of distinct texts, and where it is written if it does not fit in ``HELD`` rows."""
    spark, path = engine.spark, None
    schema = f"h string, {_OUTCOME}"
    held: list[tuple] = []
    shared = fuse.sharing(engine.as_of, engine.types, engine.strings)
    with ThreadPoolExecutor(workers) as pool:
        while True:
            some = list(islice(texts, HELD))
            if not some and (held or path):
                break
            if held:
                path = path or fresh_path(spark, "outcomes")
                spark.createDataFrame(held, schema).write.mode("append").parquet(path)
            parts = {sql: part for sql, part in zip(some, map(shared, some)) if part}
            jobs = [pool.submit(engine.run_scan, scan) for scan in fuse.scans(list(parts.values()))]
            jobs += [pool.submit(lambda t: [(t, engine.run(t))], t) for t in some if t not in parts]
            held = [(hashlib.sha256(sql.encode("utf-8", "surrogatepass")).hexdigest(), *outcome) for job in jobs for sql, outcome in job.result()]
            if len(some) < HELD:
                break
    if path is None:
        return spark.createDataFrame(held, schema), None
    if held:
        spark.createDataFrame(held, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path), path


def outcomes(engine: Engine, texts: DataFrame, workers: int, many: int = MANY) -> tuple[DataFrame, list[str]]:
    """A table of the outcomes of distinct texts (h, sql), and what was written for it. Shapes of ``many`` texts or more stay in the cluster."""
    spark, schema = engine.spark, f"h string, {_OUTCOME}"
    read = written(engine.reader.read(texts), "read")
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in _OUTCOME.split(", ")[1:-1])]
    out, paths = read.where("error IS NOT NULL").select("h", "error", *empty, F.lit(0.0).alias("seconds")), [read._written_at]
    shapes = read.where("shape IS NOT NULL").groupBy("shape").agg(F.count("*").alias("n"), F.min("spec").alias("spec"), F.min("sql").alias("sql")).where(F.col("n") >= many)
    held = {r.sql: (r.shape, fuse.part_of(r.spec, r.sql), r.n) for r in (shapes.collect() if engine.kept else [])}  # a row for ``many`` texts
    rest = read.where("error IS NULL")
    with ThreadPoolExecutor(workers) as pool:
        jobs = [pool.submit(engine.answered, [held[p.sql] for p in scan.parts], read._written_at) for scan in fuse.scans([p for _, p, _ in held.values()])]
        answered = [found for job in jobs for found in job.result()]
    for path, seconds, _ in answered:
        out = out.unionByName(spark.read.schema(schema).parquet(path).withColumn("seconds", F.lit(seconds)))
        paths.append(path)
    if answered:
        keys = spark.createDataFrame([(k,) for _, _, own in answered for k in own], "shape string")
        rest = rest.join(F.broadcast(keys), "shape", "left_anti")
    others, path = outcomes_of(engine, (r.sql for r in rest.select("sql").toLocalIterator()), workers)
    return out.unionByName(others), paths + ([path] if path else [])


def ambiguity_flags(gold_error: Column, made_error: Column, gold_rows: Column, made_rows: Column, gold_null: Column, made_null: Column) -> Column:
    """The flags of a pair in their order; after an error, results say nothing."""
    fine = gold_error.isNull() & made_error.isNull()
    g, m = gold_rows == 0, made_rows == 0
    tests = (gold_error.isNotNull(), made_error.isNotNull(), fine & g & m, fine & g & ~m, fine & ~g & m, fine & gold_null, fine & made_null)
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for t, name in zip(tests, FLAGS)]))


def evaluate_pairs(pairs: DataFrame, engine: Engine, strict: bool = False, workers: int = WORKERS) -> DataFrame:
    """``pairs`` (gold_sql, generated_sql) with everything that their execution says.

    Adds: both execution statuses, errors and previews, execution_match,
    ambiguity_flags, evaluation_group (``strict``: empty and all-null results
    are ambiguous), excluded_from_primary_metrics, error_message (with columns
    baseline_status and baseline_error, if there are any) and
    evaluation_time_seconds. Rows are kept one for one; null and blank queries
    are errors.
    """
    hashed = pairs
    for side, column in (("g", "gold_sql"), ("m", "generated_sql")):
        hashed = hashed.withColumn(f"_{side}", F.sha2(F.coalesce(column, F.lit("")), 256))
    texts = pairs.select(F.explode(F.array(F.coalesce("gold_sql", F.lit("")), F.coalesce("generated_sql", F.lit("")))).alias("sql")).distinct()
    found, paths = outcomes(engine, texts.select(F.sha2("sql", 256).alias("h"), "sql"), workers)
    for side in ("g", "m"):
        own = found.select(*[F.col(c).alias(f"_{side}_{c}" if c != "h" else f"_{side}") for c in found.columns])
        hashed = hashed.join(own, f"_{side}", "left")
    c = F.col
    digests = F.when(c("gold_sql").rlike(_ORDERED), c("_g_in_order") == c("_m_in_order")).otherwise(c("_g_as_bag") == c("_m_as_bag"))
    made_error = c("_m_error")
    fine = c("_g_error").isNull() & made_error.isNull()
    match = F.coalesce(fine & (c("_g_n") == c("_m_n")) & digests, F.lit(False))
    flags = ambiguity_flags(c("_g_error"), made_error, c("_g_n"), c("_m_n"), c("_g_all_null"), c("_m_all_null"))
    none = lambda *names: F.exists(flags, lambda f: f.isin(*names))
    empty = none("both_results_empty", "gold_result_empty", "gold_result_all_null"), none("generated_result_empty", "generated_result_all_null")
    group = group_of(c("_g_error").isNotNull(), made_error.isNotNull(), *empty, match, strict=strict)
    baseline = [F.when(c("baseline_status").isNotNull() & ~c("baseline_status").isin("success", ""), F.concat(F.lit("baseline status: "), "baseline_status"))] if "baseline_status" in pairs.columns else []
    baseline += [F.when(c("baseline_error") != "", F.concat(F.lit("baseline error: "), "baseline_error"))] if "baseline_error" in pairs.columns else []
    message = F.concat_ws("; ", *baseline, F.concat(F.lit("generated SQL error: "), made_error), F.concat(F.lit("gold SQL error: "), "_g_error"))
    status = lambda error: F.when(error.isNull(), "success").otherwise("error")
    out = hashed.select(
        *pairs.columns, status(made_error).alias("generated_execution_status"), status(c("_g_error")).alias("gold_execution_status"),
        c("_m_preview").alias("generated_result"), c("_g_preview").alias("gold_result"), match.alias("execution_match"), flags.alias("ambiguity_flags"),
        group.alias("evaluation_group"), (group == D).alias("excluded_from_primary_metrics"), made_error.alias("generated_error"), c("_g_error").alias("gold_error"),
        F.when(message != "", message).alias("error_message"), F.round(c("_g_seconds") + c("_m_seconds"), 4).alias("evaluation_time_seconds"),
    )
    out = written(out, "evaluated")
    for path in paths:
        remove(engine.spark, path)
    return out
