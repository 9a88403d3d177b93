"""File sources and sinks: loans CSV, application JSON/parquet, policy text.

Every reader takes an explicit schema: inference costs a full pass over
the data and can drift between files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import APPLICATION_SCHEMA, LOAN_SCHEMA

# keep leading blanks (' 36 months') and keep empty strings apart from nulls
_CSV_OPTS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "dateFormat": "yyyy-MM-dd",
}


def write_loans_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV_OPTS).csv(path)


def read_loans_csv(spark: SparkSession, path: str) -> DataFrame:
    """Loans CSV with a header, typed by ``LOAN_SCHEMA`` (no inference)."""
    return (spark.read.schema(LOAN_SCHEMA).options(**_CSV_OPTS)
            .option("mode", "PERMISSIVE").csv(path))


def read_loan_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Loans CSV as it came: the columns typed by ``LOAN_SCHEMA``, ``problems`` (for each cell that has
    another type its column, ``record:malformed`` for a line of another number of cells) and ``record``
    (such a line, else null).  A cell without a value is null and no problem."""
    names = [f.name for f in LOAN_SCHEMA.fields]
    schema = ", ".join(f"{n} string" for n in [*names, "_corrupt"])
    rows = (spark.read.schema(schema).options(**_CSV_OPTS).option("header", str(header).lower())
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path))
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in LOAN_SCHEMA.fields}
    odd = [F.when(F.col(n).isNotNull() & typed[n].isNull(), F.lit(f"{n}:type")) for n in names]
    problems = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("record:malformed"))).otherwise(F.array_compact(F.array(*odd)))
    return rows.select(*[typed[n].alias(n) for n in names], problems.alias("problems"), F.col("_corrupt").alias("record"))


def load_validation(df: DataFrame) -> DataFrame:
    """Fail flags of the load step: rows present and ``loan_amnt`` present."""
    has_col = "loan_amnt" in df.columns
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(has_col).alias("has_loan_amnt"),
        ((F.col("n_rows") > 0) & F.lit(has_col)).alias("passed"),
    )


def assert_loaded(df: DataFrame) -> DataFrame:
    """Driver-side guard: raise if the table is empty or lacks ``loan_amnt``."""
    if "loan_amnt" not in df.columns:
        raise ValueError("Missing required column: loan_amnt")
    if df.isEmpty():
        raise ValueError("Dataset is empty")
    return df


def load_profile(df: DataFrame) -> DataFrame:
    """Row count, column count and the column list of a loaded table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def write_applications_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_applications(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Well-formed application records with the request schema.  Lines from outside go through
    ``read_application_records``, which keeps what cannot be parsed."""
    return spark.read.schema(APPLICATION_SCHEMA).format(fmt).load(path)


def read_application_records(spark: SparkSession, path: str) -> DataFrame:
    """Application lines as they came: app_id and the fields as strings, ``record`` (the line) and
    ``_corrupt`` (the line again if it is no JSON object, else null)."""
    names = [f.name for f in APPLICATION_SCHEMA.fields]
    schema = ", ".join(f"{n} string" for n in [*names, "_corrupt"])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    lines = spark.read.text(path).select(F.col("value").alias("record"), parsed.alias("r"))
    corrupt = F.when(F.col("r").isNull(), F.col("record")).otherwise(F.col("r._corrupt"))
    return lines.select(*[F.col(f"r.{n}").alias(n) for n in names], "record", corrupt.alias("_corrupt"))


#: Separates the documents of a file that holds many (never part of a text: ASCII's record separator).
RECORD_SEPARATOR = "\x1e"


def write_policies(df: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Many documents to a file: each one its id, a line end and the text."""
    doc = F.concat(F.col(id_col).cast("string"), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))
    df.select(doc.alias("value")).write.option("lineSep", RECORD_SEPARATOR).text(path)


def read_policies(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Whole policy documents with their source path: (path, text).  Files hold one document each,
    or, with ``separator``, many."""
    files = spark.read.option("lineSep", separator).text(path) if separator else spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
