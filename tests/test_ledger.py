"""Texts of the ledger in one pass over its lines, and XML read without code that fails to compile."""

import pytest
from pyspark.sql import functions as F

from docledger.session import configure
from docledger.sources import markup
from docledger.sources.ledger import Ledger


@pytest.mark.parametrize("language", [None, "en", "pl"])
def test_texts_take_one_pass_over_the_lines(spark, data, language):
    ledger = Ledger(spark, data)
    docs = ledger.render(language)
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 1
    paged = ledger.render(language, page_lines=1_000_000)
    assert docs.count() == paged.count() == ledger.orders.count()
    keys = ("doc_id", "page", "text", "source", F.map_entries("metadata").alias("metadata"))
    assert docs.select(*keys).exceptAll(paged.select(*keys)).count() == 0


def test_stages_of_many_expressions_are_compiled(spark):
    assert configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_generic_xml_needs_no_code_that_fails_to_compile(spark):
    texts = spark.range(2).select(F.when(F.col("id") == 0, "<a><b>x</b><c>7</c></a>").alias("xml"))
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        v = texts.select(markup.read_generic_xml(F.col("xml")).alias("v"))
        rows = v.select(F.try_variant_get("v", "$.b", "string").alias("b"), F.try_variant_get("v", "$.c", "long").alias("c")).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.factoryMode")
    assert sorted(map(tuple, rows), key=str) == [("x", 7), (None, None)]
