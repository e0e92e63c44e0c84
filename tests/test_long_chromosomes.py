from kinweave.sources.scratch import scratch
from kinweave.streaming import pileup as st


def test_positions_far_out(spark):
    """Lines of one chromosome aren't taken for the next one's, however far its positions go."""
    source, out, marks = (scratch(spark, n) for n in ("far", "first", "marks"))
    far = 6_000_000_000
    for lot in ([(1, 5), (1, far)], [(2, 7), (2, far), (1, far)], [(3, 1), (3, far)]):
        lines = [(f"{c}\t{p}\tA\t1\t.\tI\t1\tC\tI",) for c, p in lot]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(source)
        kept = st.first_lines_within(st.line_pairs(st.stream_pileup(spark, source, 10)), st.CHROM_SPAN * 3 // 2)
        kept.writeStream.outputMode("append").option("checkpointLocation", marks).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
    found = sorted((r["chrom"], r["pos"]) for r in spark.read.parquet(out).collect())
    assert found == [(1, 5), (1, far), (2, 7), (2, far), (3, 1), (3, far)]
