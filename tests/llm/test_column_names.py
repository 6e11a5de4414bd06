"""Stages keep extra columns, whatever their names."""

import pytest
from pyspark.sql import functions as F

from evenlend.llm import decontaminate, linededup, nearcopies, simhash

NAMES = ["__key", "__gone", "__new", "__copy", "__id", "__text", "_KEY", "key", "component", "line_no", "fp", "least"]
BODY = "one two three four five six seven eight nine ten eleven twelve thirteen"


@pytest.mark.parametrize(
    "stage",
    [
        linededup.dedup_lines,
        nearcopies.drop_near_copies,
        simhash.drop_near_duplicates,
        lambda d: decontaminate.drop_contaminated(d, d.sparkSession.createDataFrame([(1, "a window that nobody has")], "item_id long, text string")),
    ],
)
def test_clashing_columns_stay(spark, stage):
    docs = spark.createDataFrame([(1, f"{BODY}\nfirst own line"), (2, f"{BODY}\nanother line here"), (3, None), (4, "")], "doc_id long, text string")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}/"), F.col("doc_id").cast("string")) for n in NAMES})
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}/{r['doc_id']}" for r in rows for n in NAMES)
