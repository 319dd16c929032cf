"""A plan holds one block of the benchmark."""

from panelwright.llm import decontaminate


def test_each_block_has_a_plan_of_its_own(spark):
    texts = [f"first{i} second third fourth{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, f"so {t} it is") for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    found = decontaminate.search(docs, benchmark, block_bytes=120)
    assert found._jdf.queryExecution().toString().count("MapInArrow") <= 4  # once in each form of the plan
    assert {r["doc_id"]: r["items"] for r in found.collect()} == {i: [str(i)] for i in range(12)}
