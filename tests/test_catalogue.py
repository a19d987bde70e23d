"""A cross-section of the registered queries against their SQL on the smallest tables; check.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, compare

SAMPLE = ("derived_books", "fea_03", "acc_calculations", "fil_02", "led_01", "val_24", "val_30", "val_33", "nrm_02", "nrm_17", "cls_04", "cls_06",
          "cls_08", "flt_01", "agg_12", "win_05", "win_06", "top_02", "set_04", "dsh_02", "crt_01", "adj_04", "adj_05", "ml_03", "ml_16", "qa_01",
          "qa_11", "spc_01", "spc_05")


@pytest.fixture(scope="module")
def con(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, folder, name):
    text, _, ok = compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql()[name], folder)
    assert ok, text


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 43
