import re

import pytest

import __spark_entry__ as entry_module
from tests.samples import CONTRA, CREDIT_NOTE, PAYMENT, REJECTION_IN, table
from voucherflow.operators import rules as R

COMPILED = 8_000    # bytes up to which the JVM compiles a method; past that each row is interpreted


@pytest.mark.parametrize("name", ["cls_14", "qa_08", "nrm_11"])
def test_every_step_is_compiled(spark, folder, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = entry_module.queries()[name](spark, folder)
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= COMPILED


def test_bits_on_a_base_are_the_bits_of_the_changed_rows(spark):
    rows = [PAYMENT, CONTRA, CREDIT_NOTE, REJECTION_IN, {}]
    df = table(spark, rows)
    change = {"Payment ID": "", "Document Number": "DBN-1", "Item Rejected": ""}
    fields = {n: R.F.lit(v) for n, v in change.items()}
    got = R.with_evidence(R.with_field_bits(df, "b_"), "p_", fields, "b_").orderBy("ord").select("p_clause_bits", "p_family_bits").collect()
    want = R.with_evidence(table(spark, [{**r, **change} for r in rows])).orderBy("ord").select("clause_bits", "family_bits").collect()
    assert [tuple(x) for x in got] == [tuple(x) for x in want]
