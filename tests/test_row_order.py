"""Means of a customer's lines, added in the order of the table: individuals whose means tie keep the places that the SQL
gives them, however the lines are joined and split."""

import duckdb
import pytest

from compare import DATA, TABLES, connection, difference
from seqloom.catalog import entries
from seqloom.catalog.bindings import measurements

COPIES = 4
SHIFTS = {
    "customer": {"c_custkey": 150}, "orders": {"o_custkey": 150, "o_orderkey": 1500}, "lineitem": {"l_orderkey": 1500},
    "documents": {"doc_id": 200},
}
VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Every customer four times, so that most of the lowest and highest tie."""
    folder = tmp_path_factory.mktemp("copied")
    for name in set(TABLES) - set(SHIFTS):
        (folder / f"{name}.parquet").symlink_to(DATA / "sf0.001" / f"{name}.parquet")
    for name, keys in SHIFTS.items():
        shifted = ", ".join(f"{key} + copy * {shift} AS {key}" for key, shift in keys.items())
        duckdb.sql(
            f"COPY (SELECT * EXCLUDE (copy, file_row_number) REPLACE ({shifted}) "
            f"FROM read_parquet('{DATA}/sf0.001/{name}.parquet', file_row_number = true), range({COPIES}) AS c(copy) "
            f"ORDER BY copy, file_row_number) TO '{folder}/{name}.parquet'"
        )
    return folder


@pytest.fixture
def shuffled_joins(spark):
    """Joins by a shuffle whose partitions stay apart, as they do on larger tables."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1b",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_tied_individuals_keep_the_places_of_the_sql(spark, copied, shuffled_joins):
    assert difference(spark, connection(copied), entries()["extreme_individuals"], copied) is None


def test_means_are_sums_in_the_order_of_files_and_rows(spark, tmp_path, shuffled_joins):
    lines = duckdb.sql(f"FROM '{DATA}/sf0.001/lineitem.parquet' LIMIT 5000").fetchall()
    columns = duckdb.sql(f"FROM '{DATA}/sf0.001/lineitem.parquet' LIMIT 0").columns
    (tmp_path / "lineitem.parquet").mkdir()
    (tmp_path / "orders.parquet").symlink_to(DATA / "sf0.001" / "orders.parquet")
    for part in range(3):
        duckdb.sql(f"COPY (FROM '{DATA}/sf0.001/lineitem.parquet' LIMIT {[2000, 100, 2900][part]} OFFSET {[0, 2000, 2100][part]}) "
                   f"TO '{tmp_path}/lineitem.parquet/part-{part}.parquet'")
    customer = dict(duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{DATA}/sf0.001/orders.parquet'").fetchall())
    sums = {}
    for row in lines:
        line = dict(zip(columns, row))
        if line["l_orderkey"] in customer:
            n, so_far = sums.get(customer[line["l_orderkey"]], (0, [0.0] * 4))
            sums[customer[line["l_orderkey"]]] = n + 1, [s + line[v] for s, v in zip(so_far, VALUES)]
    got = measurements(spark, str(tmp_path)).collect()
    assert {r["idv_id"]: [r["toughness"], r["young's_modulus"], r["tensile_strength"], r["strain_at_break"]] for r in got} == {
        k: [s / n for s in total] for k, (n, total) in sums.items()}
