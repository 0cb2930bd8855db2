"""Scans and sinks of evaluation records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.operators.dataflow import numbered
from ledgerlens.sources.scratch import exists

#: Columns of a question's record.
QUESTION = ("question_id", "db_id", "question", "gold_sql", "level", "split")


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines; blank lines are skipped. strict: a malformed line fails the read; tolerant: it is skipped (for resuming)."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if mode == "strict" else "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold no JSON object: line (from 1) and text, in order. Files are read in the order of their names."""
    lines = numbered(spark.read.text(path).select("value"), "at")
    parsed = F.try_parse_json("value")
    fine = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return lines.where((F.trim("value") != "") & ~fine).select((F.col("at") + 1).alias("line"), F.col("value").alias("text")).orderBy("line")


def read_checked(spark: SparkSession, path: str, schema: str, unique: str | None = None) -> DataFrame:
    """JSON lines that are looked through first: ValueError names the first line that holds no object, and the first id that is missing or repeated."""
    found = bad_lines(spark, path).take(1)
    if found:
        raise ValueError(f"{path}, line {found[0].line}: no JSON object")
    rows = read_jsonl(spark, path, schema)
    if unique:
        twice = rows.groupBy(unique).count().where(F.col(unique).isNull() | (F.col(unique) == "") | (F.col("count") > 1)).take(1)
        if twice:
            raise ValueError(f"{path}: {unique} {twice[0][unique]!r} is missing or repeated")
    return rows


def read_document(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("data", "records", "examples", "rows")) -> DataFrame:
    """One JSON document: a list of records, or an object that holds the list under one of ``keys``."""
    wrapped = ", ".join(f"`{k}` ARRAY<STRUCT<{schema}>>" for k in keys)
    text = spark.read.text(path, wholetext=True).select("value")
    listed = F.from_json("value", f"ARRAY<STRUCT<{schema}>>")
    held = F.from_json("value", wrapped)
    rows = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(*[held[k] for k in keys]))
    return text.select(F.explode(rows).alias("r")).select("r.*")


def read_many(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON lines of all files of a pattern, each row with the name of its file (``file_name``)."""
    return spark.read.schema(schema).json(pattern).withColumn("file_name", F.col("_metadata.file_name"))


def with_origin(df: DataFrame, group: str = "evaluation_group", mode: str = "probing_mode", name: str = "file_name") -> DataFrame:
    """``df`` with group and mode as the record says, else as its file's name does (``verified_groupX_mode``); direct stands for none. Neither: reading fails."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    part = lambda n: F.when(stem.startswith("verified_"), F.get(F.split(stem, "_"), n))
    said = F.when(F.col(mode) == "none", "direct").otherwise(F.when(F.col(mode) != "", F.col(mode)))
    by_name = F.when(part(1) == "groupA", "A_correct_executable").when(part(1) == "groupB", "B_wrong_executable")
    lost = lambda what: F.raise_error(F.concat(F.lit(f"no {what} for "), name)).cast("string")
    return df.withColumns({"origin_group": F.coalesce(F.when(F.col(group) != "", F.col(group)), by_name, lost("group")), "origin_mode": F.coalesce(said, part(2), lost("mode"))})


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """The rows of ``df``; reading them fails on a null or repeated key."""
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    checked = F.when(F.col(key).isNotNull() & (F.col("_n") == 1), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"missing or repeated {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return counted.where(checked).drop("_n")


def split_name(column: str | Column) -> Column:
    """Names of the validation split are one; others are trimmed and lower-cased."""
    plain = F.lower(F.trim(column))
    return F.when(plain.isin("val", "dev", "validation"), "validation").otherwise(plain)


def with_question_ids(df: DataFrame, order: str | None, prefix: str = "booksql_", digits: int = 6) -> DataFrame:
    """Numbers rows by position (in an order, or as they come) without gathering them."""
    placed = numbered(df.orderBy(order) if order else df, "_at")
    return placed.withColumn("question_id", F.format_string(f"{prefix}%0{digits}d", "_at")).drop("_at")


def question_records(df: DataFrame, db_id: str, question: str = "Query", sql: str = "SQL", level: str = "Levels", split: str = "split", prefix: str = "booksql_", digits: int = 6) -> DataFrame:
    """Source rows as records of six columns, numbered as they come; a missing column is an error."""
    missing = [c for c in (question, sql, level, split) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing} of {sorted(df.columns)}")
    rows = df.select(F.lit(db_id).alias("db_id"), F.col(question).alias("question"), F.col(sql).alias("gold_sql"), F.col(level).alias("level"), split_name(split).alias("split"))
    return with_question_ids(rows, None, prefix, digits).select(*QUESTION)


def load_records(df: DataFrame, schema_text: str, split: str | None = None, gold: bool = True) -> DataFrame:
    """Records of a split (of all without one) with the schema's text; missing columns and an empty split are errors. Without ``gold`` no gold_sql is needed."""
    missing = [c for c in QUESTION if c not in df.columns and (gold or c != "gold_sql")]
    if missing:
        raise ValueError(f"missing columns {missing} of {sorted(df.columns)}")
    gold_sql = F.col("gold_sql") if "gold_sql" in df.columns else F.lit(None).cast("string").alias("gold_sql")
    rows = df.withColumn("split", split_name("split")).select("question_id", "db_id", "question", gold_sql, F.lit(schema_text).alias("schema"), "level", "split")
    if split is not None:
        rows = rows.where(F.col("split") == split_name(F.lit(split)))
        if rows.isEmpty():
            raise ValueError(f"no records of split {split!r}")
    return rows


# Catalog


def columns_of_tables(tables: dict[str, DataFrame], keys: dict[str, str] | None = None) -> DataFrame:
    """What a catalog says: table, place (from 0), column, type, primary_key."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, n, f.name, f.dataType.simpleString(), (keys or {}).get(t) == f.name) for t, df in sorted(tables.items()) for n, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table string, place int, column string, type string, primary_key boolean")


def schema_text(tables: dict[str, DataFrame], keys: dict[str, str] | None = None, foreign: list[tuple[str, str, str, str]] | None = None) -> str:
    """The tables as text for a prompt: columns with types and primary keys, then foreign keys (table, column, referenced table, referenced column)."""
    if not tables:
        raise ValueError("no tables")
    lines = ["Database schema:"]
    for name, df in sorted(tables.items()):
        lines += ["", f"Table: {name}", "Columns:"]
        lines += [f"  - {f.name}: {f.dataType.simpleString().upper()}" + (", primary key" if (keys or {}).get(name) == f.name else "") for f in df.schema]
    if foreign:
        lines += ["", "Foreign keys:", *(f"  {t}.{c} -> {rt}.{rc}" for t, c, rt, rc in foreign)]
    return "\n".join(lines)


def annotation_template(tables: dict[str, DataFrame]) -> dict:
    """An empty annotation document of all columns."""
    return {t: {f.name: {"description": "", "semantic_role": None, "measure_type": None, "unit": None} for f in df.schema} for t, df in sorted(tables.items())}


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """SHA-256 of whole files: path, length, sha256."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


# Sinks


def guarded(spark: SparkSession, paths: list[str], overwrite: bool = False) -> None:
    """FileExistsError if one of several outputs is there already, before any is written."""
    there = [p for p in paths if not overwrite and exists(spark, p)]
    if there:
        raise FileExistsError(", ".join(there))


def write_jsonl(df: DataFrame, path: str, order: str | None = None, overwrite: bool = True) -> None:
    """JSON lines with nulls, in an order across files; columns that begin with an underscore stay out."""
    shown = df.select(*[c for c in df.columns if not c.startswith("_")])
    rows = shown.orderBy(order) if order else shown
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_document(value: dict | DataFrame, path: str, spark: SparkSession) -> None:
    """One JSON document (of a frame, its only row) as a file in a folder."""
    held = json.loads(value.toJSON().first()) if isinstance(value, DataFrame) else value
    spark.createDataFrame([(json.dumps(held, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_text(text: str, path: str, spark: SparkSession) -> None:
    """A report's text as a file in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def flattened(df: DataFrame) -> DataFrame:
    """All columns as text: nested ones as JSON, nulls empty."""
    return df.select(*[F.coalesce(F.to_json(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header, columns in a fixed order if they are named; refuses to overwrite."""
    flattened(df.select(*columns) if columns else df).write.mode("errorifexists").csv(path, header=True)


def submission(df: DataFrame, id_column: str = "id", sql_column: str = "pred_sql") -> DataFrame:
    """Rows for submission in id order; reading fails unless ids are 0 to n - 1, each once."""
    seen = df.agg(F.count("*").alias("n"), F.count_distinct(id_column).alias("d"), F.min(id_column).alias("low"), F.max(id_column).alias("high"))
    fine = (F.col("n") == F.col("d")) & ((F.col("n") == 0) | ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1)))
    checked = seen.select(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("ids are not contiguous")).cast("boolean")).alias("fine"))
    return df.crossJoin(F.broadcast(checked)).where("fine").select(F.col(id_column).alias("id"), F.col(sql_column).alias("pred_sql")).orderBy("id")


def write_submission(df: DataFrame, path: str, id_column: str = "id", sql_column: str = "pred_sql") -> None:
    """The submission as CSV with the columns id and pred_sql."""
    submission(df, id_column, sql_column).write.mode("errorifexists").csv(path, header=True)
