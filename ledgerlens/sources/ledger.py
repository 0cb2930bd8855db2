"""Ledger and evaluation-record tables, and their derivation from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The seven ledger tables as DDL schemas.
LEDGER = {
    "chart_of_accounts": "id LONG, businessID LONG, Account_name STRING, Account_type STRING",
    "customers": "id LONG, businessID LONG, customer_name STRING, customer_full_name STRING, Billing_address STRING, Billing_city STRING, Billing_state STRING, Billing_ZIP_code LONG, Shipping_address STRING, Shipping_city STRING, Shipping_state STRING, Shipping_ZIP_code LONG, Balance DOUBLE",
    "employees": "id LONG, businessID STRING, Employee_name STRING, Employee_ID STRING, Hire_date DATE, Billing_rate DOUBLE, Deleted STRING",
    "master_txn_table": "id LONG, businessID LONG, Transaction_ID LONG, Transaction_DATE DATE, Transaction_TYPE STRING, Amount DOUBLE, CreatedDATE DATE, CreatedUSER STRING, Account STRING, AR_paid STRING, AP_paid STRING, Due_DATE DATE, Open_balance DOUBLE, Customers STRING, Vendor STRING, Product_Service STRING, Quantity LONG, Rate DOUBLE, Credit DOUBLE, Debit DOUBLE, payment_method STRING, Misc STRING",
    "payment_method": "id LONG, businessID STRING, Payment_method STRING, Credit_card STRING",
    "products": "id LONG, businessID STRING, Product_Service STRING, Product_Service_type STRING",
    "vendors": "id LONG, businessID STRING, Vendor_name STRING, Billing_address STRING, Billing_city STRING, Billing_state STRING, Billing_ZIP_code LONG, Balance DOUBLE",
}
RECORDS = {
    "question": "question_id STRING, db_id STRING, question STRING, gold_sql STRING, level STRING, split STRING",
    "pair": "question_id STRING, gold_sql STRING, generated_sql STRING",
}
A, B, C, D = "A_correct_executable", "B_wrong_executable", "C_non_executable", "D_ambiguous"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, parts: int = 3) -> DataFrame:
    """A scan in ``parts`` partitions a core or more, for steps that cost far more than to read their rows: small files come in few."""
    wanted = parts * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lines; the joins are left to the optimiser, which broadcasts what is small. Orders meet their customers before the lines, which are four times as many and cross one exchange less."""
    get = lambda name: table(spark, sf_dir, name)
    lines = get("lineitem").join(get("orders").join(get("customer"), F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(get("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(get("part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice")
    return lines.select(
        F.col("l_orderkey").alias("Transaction_ID"),
        F.col("l_shipdate").cast("date").alias("Transaction_DATE"),
        F.when(F.col("l_returnflag") == "R", "bill").when(F.col("l_returnflag") == "A", "deposit").otherwise("invoice").alias("Transaction_TYPE"),
        price.alias("Amount"),
        F.col("p_type").alias("Account"),
        F.col("c_name").alias("Customers"),
        F.col("s_name").alias("Vendor"),
        F.col("p_name").alias("Product_Service"),
        F.col("l_quantity").alias("Quantity"),
        (price / F.col("l_quantity")).alias("Rate"),
        F.when(F.col("l_linestatus") == "F", price).otherwise(0.0).alias("Debit"),
        F.when(F.col("l_linestatus") == "O", price).otherwise(0.0).alias("Credit"),
        F.when(F.col("l_orderkey") % 3 == 0, "paid").otherwise("--").alias("AR_paid"),
    )


def evaluation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluated question for each order, every flag by integer arithmetic."""
    key = F.col("o_orderkey")
    before = F.when(key % 13 == 0, D).when(key % 13 == 1, C).when((key % 13).isin(2, 3), B).otherwise(A)
    after = F.when(key % 17 == 0, B).when(key % 17 == 1, C).otherwise(A)
    return table(spark, sf_dir, "orders").select(
        key.alias("idx"),
        F.format_string("q_%08d", key).alias("question_id"),
        before.alias("before_group"),
        after.alias("after_group"),
        (key % 5 == 0).alias("repaired"),
        (key % 7).cast("long").alias("probes_used"),
        F.when(key % 4 == 1, F.lit(True)).when(key % 4 == 3, F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("answers_question"),
        F.when(key % 3 == 0, "none").when(key % 3 == 1, "probe").otherwise("hybrid").alias("mode"),
        F.when(key % 6 == 0, F.lit(None).cast("int")).otherwise((key % 2).cast("int")).alias("inv"),
        F.col("o_totalprice").alias("seconds"),
    )


#: A verification as rows of a repair run hold it.
VERIFICATION = "answers_question boolean, should_abstain boolean, ambiguous boolean, confidence string, probes_used int, mismatch_type string, repair_hint string, stage2_failed_evidence array<string>"


def repair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repaired question for each order: what it was, what was tried, and what it became."""
    key = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    status = F.when(key % 7 == 0, "skipped").when(key % 11 == 0, "failed").otherwise("success")
    generated = F.when(key % 29 != 0, F.concat(F.lit("select "), F.col("o_custkey")))
    repaired = F.when((status == "success") & (key % 5 < 2), F.concat(F.lit("select "), key)).when(key % 5 == 2, " ")
    verification = F.struct(
        F.when(key % 4 == 1, F.lit(True)).when(key % 4 == 3, F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("answers_question"),
        (key % 10 == 0).alias("should_abstain"), (key % 9 == 0).alias("ambiguous"), F.when(key % 3 == 0, "high").when(key % 3 == 1, "HIGH").otherwise("low").alias("confidence"),
        (key % 7).cast("int").alias("probes_used"), F.when(key % 8 != 0, F.when(key % 2 == 0, "financial_object_error").otherwise("financial_measure_error")).alias("mismatch_type"),
        F.when(key % 5 != 0, "use the other side").otherwise(" ").alias("repair_hint"), F.when(key % 6 != 0, F.array(F.concat(F.lit("e"), key % 3))).otherwise(F.array().cast("array<string>")).alias("stage2_failed_evidence"),
    )
    return evaluation_records(spark, sf_dir).select("idx", "question_id", F.col("before_group").alias("evaluation_group"), "after_group", "mode", "inv").join(
        table(spark, sf_dir, "orders").select(
            key.alias("idx"), F.when(key % 2 == 0, "validation").otherwise("train").alias("split"), F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (key % 3 + 1).cast("int")).alias("level"),
            F.concat(F.lit("total of "), "o_custkey").alias("question"), F.concat(F.lit("select "), key).alias("gold_sql"), generated.alias("generated_sql"), repaired.alias("repaired_sql"), status.alias("status"),
            F.when(key % 23 == 0, null).otherwise(status).alias("repair_status"), F.when(key % 3 == 0, "semantic").when(key % 3 == 1, "non_executable").otherwise("generic_semantic_repair").alias("repair_mode"),
            F.when(key % 31 == 0, "chain").alias("final_sql_source"), F.when(key % 19 != 0, verification).alias("verification"), F.when(key % 5 != 4, '{"slots": {}}').alias("intent_representation"), F.when(key % 21 != 0, "{}").alias("execution_profile"),
        ),
        "idx",
    )


#: ``repair_records`` in DuckDB SQL, as a common table expression after those of ``EV_SQL``.
REP_SQL = """rep AS (
  SELECT e.idx, e.question_id, e.before_group AS evaluation_group, e.after_group, e.mode, e.inv,
    CASE WHEN e.idx % 2 = 0 THEN 'validation' ELSE 'train' END AS split, ['easy', 'medium', 'hard'][CAST(e.idx % 3 + 1 AS INT)] AS level,
    'total of ' || o_custkey AS question, 'select ' || e.idx AS gold_sql,
    CASE WHEN e.idx % 29 <> 0 THEN 'select ' || o_custkey END AS generated_sql,
    CASE WHEN e.idx % 7 <> 0 AND e.idx % 11 <> 0 AND e.idx % 5 IN (0, 1) THEN 'select ' || e.idx WHEN e.idx % 5 = 2 THEN ' ' END AS repaired_sql,
    CASE WHEN e.idx % 7 = 0 THEN 'skipped' WHEN e.idx % 11 = 0 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN e.idx % 23 = 0 THEN NULL WHEN e.idx % 7 = 0 THEN 'skipped' WHEN e.idx % 11 = 0 THEN 'failed' ELSE 'success' END AS repair_status,
    CASE e.idx % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'non_executable' ELSE 'generic_semantic_repair' END AS repair_mode,
    CASE WHEN e.idx % 31 = 0 THEN 'chain' END AS final_sql_source, e.idx % 19 <> 0 AS has_verification,
    CASE WHEN e.idx % 19 = 0 OR e.idx % 4 = 3 THEN CAST(NULL AS BOOLEAN) ELSE e.idx % 4 = 1 END AS answers, e.idx % 19 <> 0 AND e.idx % 10 = 0 AS abstain, e.idx % 19 <> 0 AND e.idx % 9 = 0 AS ambiguous,
    CASE WHEN e.idx % 19 = 0 THEN NULL WHEN e.idx % 3 < 2 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN e.idx % 19 = 0 THEN 0 ELSE e.idx % 7 END AS probes,
    CASE WHEN e.idx % 19 <> 0 AND e.idx % 8 <> 0 THEN CASE WHEN e.idx % 2 = 0 THEN 'financial_object_error' ELSE 'financial_measure_error' END END AS mismatch, e.idx % 19 <> 0 AND e.idx % 5 <> 0 AS hinted
  FROM ev e JOIN orders ON o_orderkey = e.idx)"""

#: The same derivations in DuckDB SQL, as common table expressions.
LED_SQL = """led AS (
  SELECT l_orderkey AS Transaction_ID, CAST(l_shipdate AS DATE) AS Transaction_DATE,
    CASE l_returnflag WHEN 'R' THEN 'bill' WHEN 'A' THEN 'deposit' ELSE 'invoice' END AS Transaction_TYPE,
    l_extendedprice AS Amount, p_type AS Account, c_name AS Customers, s_name AS Vendor, p_name AS Product_Service,
    l_quantity AS Quantity, l_extendedprice / l_quantity AS Rate,
    CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0.0 END AS Debit,
    CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0.0 END AS Credit,
    CASE WHEN l_orderkey % 3 = 0 THEN 'paid' ELSE '--' END AS AR_paid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
EV_SQL = """ev AS (
  SELECT o_orderkey AS idx, printf('q_%08d', o_orderkey) AS question_id,
    CASE o_orderkey % 13 WHEN 0 THEN 'D_ambiguous' WHEN 1 THEN 'C_non_executable' WHEN 2 THEN 'B_wrong_executable'
      WHEN 3 THEN 'B_wrong_executable' ELSE 'A_correct_executable' END AS before_group,
    CASE o_orderkey % 17 WHEN 0 THEN 'B_wrong_executable' WHEN 1 THEN 'C_non_executable' ELSE 'A_correct_executable' END AS after_group,
    o_orderkey % 5 = 0 AS repaired, CAST(o_orderkey % 7 AS BIGINT) AS probes_used,
    CASE o_orderkey % 4 WHEN 1 THEN true WHEN 3 THEN CAST(NULL AS BOOLEAN) ELSE false END AS answers_question,
    CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'probe' ELSE 'hybrid' END AS mode,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INT) END AS inv,
    o_totalprice AS seconds
  FROM orders)"""
