"""Raw loan records derived from the driver's ``orders`` and ``customer`` tables.

The same SQL text feeds Spark (through DataFrame parameters of
``spark.sql``) and the DuckDB oracle (through its pre-registered views), so
both sides start from identical rows.  All arithmetic is on integers or
exact divisions, so no engine-dependent rounding enters the fixture.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession

from ..schemas import LOAN_SCHEMA
from ..session import app_id, parallelism, scratch_path
from .tables import read_table

_FIXTURE_SQL = """
SELECT
  o.o_orderkey AS loan_id,
  CASE WHEN o.o_orderkey % 97 = 5 THEN NULL ELSE CAST(1000 + (o.o_orderkey * 7919) % 39001 AS DOUBLE) END AS loan_amnt,
  CASE WHEN o.o_orderkey % 101 = 7 THEN 'n/a' WHEN o.o_orderkey % 10 < 7 THEN ' 36 months' ELSE ' 60 months' END AS term,
  CAST(50 + (o.o_orderkey * 31) % 251 AS DOUBLE) / 10 AS int_rate,
  CAST(50 + (o.o_orderkey * 53) % 1451 AS DOUBLE) AS installment,
  CASE WHEN o.o_orderkey % 211 = 3 THEN NULL WHEN o.o_orderkey % 211 = 4 THEN 'H' ELSE substring('ABCDEFG', CAST((o.o_orderkey * 13) % 7 AS INT) + 1, 1) END AS grade,
  CASE WHEN o.o_orderkey % 211 = 3 THEN NULL WHEN o.o_orderkey % 211 = 4 THEN 'H9' ELSE concat(substring('ABCDEFG', CAST((o.o_orderkey * 13) % 7 AS INT) + 1, 1), CAST((o.o_orderkey * 3) % 5 + 1 AS VARCHAR(1))) END AS sub_grade,
  CASE WHEN o.o_orderkey % 89 = 11 THEN NULL WHEN o.o_orderkey % 89 = 12 THEN CAST(0 AS DOUBLE) ELSE CAST(10000 + CAST(floor(abs(c.c_acctbal)) AS BIGINT) * 25 AS DOUBLE) END AS annual_inc,
  CASE WHEN o.o_orderkey % 83 = 1 THEN NULL WHEN o.o_orderkey % 83 = 2 THEN CAST(-1 AS DOUBLE) ELSE CAST((o.o_orderkey * 17) % 601 AS DOUBLE) / 10 END AS dti,
  CASE WHEN (o.o_orderkey * 7) % 13 = 12 THEN NULL WHEN (o.o_orderkey * 7) % 13 = 11 THEN 'n/a' WHEN (o.o_orderkey * 7) % 13 = 0 THEN '< 1 year' WHEN (o.o_orderkey * 7) % 13 = 1 THEN '1 year' WHEN (o.o_orderkey * 7) % 13 = 10 THEN '10+ years' ELSE concat(CAST((o.o_orderkey * 7) % 13 AS VARCHAR(2)), ' years') END AS emp_length,
  CAST(580 + (o.o_orderkey * 29) % 271 AS BIGINT) AS fico_range_low,
  CAST(584 + (o.o_orderkey * 29) % 271 AS BIGINT) AS fico_range_high,
  CAST((o.o_orderkey * 11) % 41 AS BIGINT) AS open_acc,
  CASE WHEN o.o_orderkey % 23 = 9 THEN NULL ELSE CAST((o.o_orderkey * 5) % 4 AS BIGINT) END AS pub_rec,
  CAST(floor(o.o_totalprice / 5) AS DOUBLE) AS revol_bal,
  CASE WHEN o.o_orderkey % 29 = 4 THEN NULL ELSE CAST((o.o_orderkey * 37) % 1001 AS DOUBLE) / 10 END AS revol_util,
  CAST((o.o_orderkey * 19) % 61 AS BIGINT) AS total_acc,
  CASE WHEN o.o_orderkey % 19 = 6 THEN NULL ELSE CAST((o.o_orderkey * 3) % 11 AS BIGINT) END AS mort_acc,
  CASE WHEN o.o_orderkey % 31 = 8 THEN NULL ELSE CAST((o.o_orderkey * 3) % 6 AS BIGINT) END AS pub_rec_bankruptcies,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'RENT' WHEN 'BUILDING' THEN 'MORTGAGE' WHEN 'FURNITURE' THEN 'OWN' WHEN 'HOUSEHOLD' THEN 'OTHER' WHEN 'MACHINERY' THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'NONE' ELSE 'ANY' END END AS home_ownership,
  CASE (o.o_orderkey * 5) % 14 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'debt_consolidation' WHEN 2 THEN 'educational' WHEN 3 THEN 'home_improvement' WHEN 4 THEN 'house' WHEN 5 THEN 'major_purchase' WHEN 6 THEN 'medical' WHEN 7 THEN 'moving' WHEN 8 THEN 'other' WHEN 9 THEN 'renewable_energy' WHEN 10 THEN 'small_business' WHEN 11 THEN 'vacation' WHEN 12 THEN 'wedding' ELSE 'car' END AS purpose,
  CASE WHEN o.o_orderstatus = 'O' THEN 'Current'
       WHEN ((o.o_orderkey * 13) % 7) * 100 + (o.o_orderkey * 17) % 601 - 2 * ((o.o_orderkey * 29) % 271) + 10 * ((o.o_orderkey * o.o_orderkey) % 41) > 580 THEN 'Charged Off'
       ELSE 'Fully Paid' END AS loan_status,
  CAST(o.o_orderdate AS DATE) AS issue_d
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""


def fixture_sql(orders: str = "orders", customer: str = "customer") -> str:
    """The fixture as SQL text over the named relations (DuckDB oracle form)."""
    return _FIXTURE_SQL.replace("{orders}", orders).replace("{customer}", customer)


def derive_raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loan records, one per order, with the schema of ``LOAN_SCHEMA`` (lazy)."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment")
    return spark.sql(_FIXTURE_SQL, orders=orders, customer=customer)


_TABLES: dict[tuple[str, str], str] = {}
ROWS_PER_FILE = 4_000_000


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw loans table, as the pipelines read it: derived once per
    application and scale, written as parquet into the shared work folder,
    then scanned like any source table (pushdown, pruning, row-group stats).

    Writing it cuts the lineage back to orders x customer (a lost executor
    re-reads files instead of re-running the join) and keeps the fixture's
    wide CASE expressions out of every downstream stage.  Files are hash
    partitioned and sorted by ``loan_id`` so id-range filters skip row groups.
    """
    key = (app_id(spark), os.path.abspath(sf_dir))
    path = _TABLES.get(key)
    if path is None:
        path = scratch_path(spark, "raw-loans")
        # one file per core, or more when the data is large: at most about
        # ROWS_PER_FILE loans per file (the orders count reads parquet
        # footers only; the inner join cannot add rows)
        n_orders = read_table(spark, sf_dir, "orders").count()
        n_files = max(parallelism(spark), 1, math.ceil(n_orders / ROWS_PER_FILE))
        (derive_raw_loans(spark, sf_dir).repartition(n_files, "loan_id")
         .sortWithinPartitions("loan_id").write.mode("overwrite").parquet(path))
        _TABLES[key] = path
    return spark.read.schema(LOAN_SCHEMA).parquet(path)
