"""Letter coverage against its SQL on texts without letters or vowels."""

from __future__ import annotations

import duckdb

from takewright.functions import text as X
from takewright.plans import catalog

TEXTS = ["", None, "  ", "123", "bcd", "zq w x", "Ünïcode", "ȳ", "Привет", "你好", "a", "q", "\n", "́", "The quick brown fox jumps over the lazy dog", "ﬁ ß ı İ"]


def test_letter_coverage_is_that_of_its_sql(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["e23_letter_coverage"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.sql(catalog.ORACLE_SQL["e23_letter_coverage"]).fetchall())
    assert {r.doc_id: r.value for r in found}[3] == "4:17:"
    assert rows.where("doc_id = 3").select(X.letter_coverage("text").alias("c")).first().c.letters == 0  # the reference's figure stays the operator's
