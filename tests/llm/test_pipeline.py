import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from voucherflow.llm import queries


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    placed = stage_rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert stage_rows.count() == before and placed.select("doc_id").distinct().count() == before


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert set(got.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} and got.count() > 0


def test_language_keeps_and_decontamination_drops(spark, folder):
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [r["text"] for r in bench.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.decontaminate_benchmark(spark, docs, folder).collect()}
    for r in docs.collect():
        assert (r["doc_id"] in kept) != any(i in r["text"] for i in items)
    assert corpus_pipeline.identify_language(spark, docs, folder).count() == docs.count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_awkward_documents(spark, folder, stage):
    from tests.llm.helpers import awkward
    table = awkward(spark).drop("score", "shard", "h", "id", "fp", "size")
    assert stage(spark, table, folder).count() >= 1
    assert stage(spark, table.where("false"), folder).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_columns_with_the_stages_own_names_come_back_unchanged(spark, folder, stage):
    from tests.llm.helpers import awkward
    names = ("near_own", "near_n", "near_id", "leaked_id", "mix_tokens", "mix_domain", "mix_epochs", "key", "row", "node", "stays", "tokens")
    table = awkward(spark).withColumns({n: F.lit(7) for n in names})
    got = stage(spark, table, folder)
    assert got.columns == table.columns
    rows = got.collect()
    assert rows and all(r[n] == 7 for r in rows for n in names) and all(r["score"] == "x" and list(r["size"]) == [1] for r in rows)
