"""Chat records of layouts that no mapping knows."""

from pyspark.sql import functions as F

from waymark.llm import chat


def test_records_of_unknown_layouts_stand_apart(spark):
    rows = [(1, '{"prompt":"a","completion":"b"}'), (2, '{"x":{"y":"a"}}'), (3, '{"messages":[{"role":"user","content":"c"}]}'), (4, "[1]")]
    df = spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("r"))
    known, unknown = chat.by_layout(df, "r")
    assert [(r.id, len(r.turns)) for r in known.orderBy("id").collect()] == [(1, 2), (3, 1)]
    assert [(r.id, r.layout) for r in unknown.select("id", "layout").orderBy("id").collect()] == [(2, "OBJECT<x: OBJECT<y: STRING>>"), (4, "ARRAY<BIGINT>")]
