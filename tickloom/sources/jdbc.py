"""Reading and writing the tables of a PostgreSQL database over TLS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    host: str,
    database: str,
    table: str,
    user: str,
    password: str,
    port: int = 5432,
    stock_id_range: tuple[int, int] | None = None,
    partitions: int = 1,
) -> dict[str, str]:
    """Options of a JDBC read; given an id range, it is split into parallel queries."""
    options = {
        "url": f"jdbc:postgresql://{host}:{port}/{database}",
        "dbtable": table,
        "user": user,
        "password": password,
        "driver": "org.postgresql.Driver",
        "sslmode": "require",
    }
    if stock_id_range is not None:
        low, high = stock_id_range
        options |= {
            "partitionColumn": "stock_id",
            "lowerBound": str(low),
            "upperBound": str(high + 1),
            "numPartitions": str(partitions),
        }
    return options


def read_table(spark: SparkSession, **settings) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**settings)).load()


def append_table(df: DataFrame, **settings) -> None:
    df.write.format("jdbc").options(**jdbc_options(**settings)).mode("append").save()
