"""Decontamination returns a row for every row, in one block of windows or in several."""

from kinweave.llm import decontaminate

from .common import rows


def test_rows_in_blocks(spark):
    item = " ".join(f"w{i}" for i in range(60))
    texts = [item, item, "x " + item, None, "", "other words"]
    own = [(1, texts[0]), (1, texts[1]), (1, texts[2]), *((None, t) for t in texts * 3), (2, None), (2, "")]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(5 * k, 60))) for k in range(6)], "item_id long, text string")
    one = decontaminate.benchmark_hits(docs, bench)
    many = decontaminate.benchmark_hits(docs, bench, block_windows=40)
    assert many.count() == len(own) and rows(many) == rows(one)
    assert many.columns == one.columns
