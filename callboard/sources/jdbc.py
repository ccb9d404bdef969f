"""Tables of a relational database: read by ranges of a key, written so that a repeated write changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, options: dict[str, str] | None = None) -> DataFrame:
    """The table in ``parts`` ranges of a numeric key, each read by a task of its own.  Bounds come from the database, rows
    without a key are in the first range; filters and columns of later steps reach the database's queries."""
    given = {"url": url, **(options or {})}
    low, high = spark.read.format("jdbc").options(**given).option("query", f"SELECT MIN({key}) AS LOW, MAX({key}) AS HIGH FROM {table}").load().first()
    scan = spark.read.format("jdbc").options(**given).option("dbtable", table)
    if low is not None and high > low:
        scan = scan.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts))
    return scan.load()


def _run(spark: SparkSession, url: str, *statements: str, options: dict[str, str] | None = None) -> None:
    """Statements of one transaction, on a connection of the driver's."""
    properties = spark._jvm.java.util.Properties()
    for k, v in (options or {}).items():
        properties.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        for s in statements:
            connection.createStatement().executeUpdate(s)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def write(rows: DataFrame, url: str, table: str, key: tuple[str, ...], options: dict[str, str] | None = None) -> None:
    """Rows by their key into a table that exists: new ones are added, others replaced.

    Executors fill a table beside it, and one transaction moves that over, so a write that failed or is repeated leaves the
    table as one write would.  Of rows with one key any one counts; give one row a key.
    """
    spark, beside = rows.sparkSession, f"{table}_incoming"
    columns = ", ".join(rows.columns)
    if _exists(spark, url, beside, options):  # left by a write that failed
        _run(spark, url, f"DROP TABLE {beside}", options=options)
    _run(spark, url, f"CREATE TABLE {beside} AS SELECT {columns} FROM {table} WITH NO DATA", options=options)
    rows.dropDuplicates(list(key)).write.format("jdbc").options(url=url, dbtable=beside, **(options or {})).mode("append").save()
    same = " AND ".join(f"s.{c} = {table}.{c}" for c in key)
    _run(
        spark, url, f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {beside} s WHERE {same})", f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {beside}", f"DROP TABLE {beside}", options=options
    )


def _exists(spark: SparkSession, url: str, table: str, options: dict[str, str] | None) -> bool:
    try:
        spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()
    except Exception as e:
        if "does not exist" not in str(e):
            raise
        return False
    return True
