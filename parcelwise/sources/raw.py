"""Raw text tables: CSV in, column contract, Parquet out."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.sources import versions
from parcelwise.sources.manifest import check_digests, file_digests, manifest_rows
from parcelwise.sources.records import read_csv_records

# The columns each raw table must have (spelling as in the source).
RAW_COLUMNS = {
    "orders": [
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ],
    "order_items": [
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        "shipping_limit_date",
        "price",
        "freight_value",
    ],
    "order_payments": [
        "order_id",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
    ],
    "order_reviews": [
        "review_id",
        "order_id",
        "review_score",
        "review_comment_title",
        "review_comment_message",
        "review_creation_date",
        "review_answer_timestamp",
    ],
    "customers": [
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
    ],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
    "products": [
        "product_id",
        "product_category_name",
        "product_name_lenght",
        "product_description_lenght",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    ],
    "category_translation": ["product_category_name", "product_category_name_english"],
}

# The file a landed row came from.
SOURCE_FILE = "_source_file"


class ContractError(ValueError):
    """A raw table lacks expected columns, or a file is not the expected one."""


def read_csv_text(spark: SparkSession, path: str, file_column: str | None = None) -> DataFrame:
    """CSV with a header, every column as text, bound by name; quoted fields may contain line breaks.

    Large files are read by several tasks. ``file_column`` adds the name of the file a row came from.
    """
    return read_csv_records(spark, path, file_column)


def read_csv_lines(spark: SparkSession, path: str, file_column: str | None = None) -> DataFrame:
    """As ``read_csv_text`` for files without line breaks inside fields, in one pass; such a break gives wrong rows."""
    lines = spark.read.csv(path, header=True, escape='"')
    return lines.withColumn(file_column, F.col("_metadata.file_name")) if file_column else lines


def describe(df: DataFrame) -> DataFrame:
    """Column names and types in order."""
    rows = [(i, field.name, field.dataType.simpleString()) for i, field in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def check_contract(df: DataFrame, table: str, contract: Mapping[str, list[str]] = RAW_COLUMNS) -> DataFrame:
    """``df`` itself if it has every expected column; more columns are allowed."""
    missing = sorted(set(contract[table]) - set(df.columns))
    if missing:
        raise ContractError(f"{table}: missing columns {missing}")
    return df


def load_raw(
    spark: SparkSession,
    files: Mapping[str, str],
    target: str,
    expected_digests: DataFrame | None = None,
    by_lines: Collection[str] = (),
) -> dict[str, DataFrame]:
    """Land raw CSV tables as Parquet under ``target``, with a manifest, and return the landed tables.

    ``files`` maps a table name to a path or glob. Digests and all column contracts are checked before the
    first write. All tables are replaced at once when all are written, the manifest grows; a load that fails leaves
    the tables as they were. The CSV is parsed once: rows are landed with the name
    of their file, and the manifest counts the landed ones. Fields may contain line breaks in every table; those known
    to have none can be named in ``by_lines``.
    """
    digests = None
    for table, path in files.items():
        found = file_digests(spark, path).withColumn("source", F.lit(table))
        digests = found if digests is None else digests.unionByName(found)
    if expected_digests is not None:
        wrong = check_digests(digests, expected_digests).take(5)
        if wrong:
            raise ContractError(f"unexpected digest: {[row['file'] for row in wrong]}")
    texts = {}
    for table, path in files.items():
        read = read_csv_lines if table in by_lines else read_csv_text
        texts[table] = check_contract(read(spark, path, SOURCE_FILE), table)
    base = target.rstrip("/")
    with versions.replacing(spark, base) as version:
        landed = {}
        for table, text in texts.items():
            place = version.place(table)
            text.write.option("compression", "zstd").parquet(place)
            landed[table] = spark.read.parquet(place)
        manifest_rows(digests, landed, SOURCE_FILE).write.mode("append").parquet(f"{base}/manifest")
    return {table: df.drop(SOURCE_FILE) for table, df in landed.items()}


def open_raw(spark: SparkSession, target: str, tables: Collection[str]) -> dict[str, DataFrame]:
    """The raw tables as the last load that went through left them."""
    return {name: df.drop(SOURCE_FILE) for name, df in versions.open_current(spark, target, list(tables)).items()}
