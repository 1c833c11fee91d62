from pyspark.sql import functions as F

from cellgrid.llm import quality


def test_paths_come_from_all_labels(spark, monkeypatch):
    """The bad documents of the half that paths are made from are 100 of 90,000; a sample by hash of about 20,000 would have none of them."""
    n = 90_000
    rows = spark.range(n).withColumn("stratum", F.lit("en"))
    rows = rows.withColumn("hidden", (F.pmod(F.xxhash64("id"), F.lit(2)) == 0) & (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(n)) >= 40_000))
    few = [r[0] for r in rows.where("hidden").orderBy("id").limit(100).collect()]
    marked = rows.withColumn("bad", F.col("id").isin(few))
    measured = marked.select("id", "stratum", *[F.lit(100 if c == "n_words" else 0).cast("long").alias(c) for c in quality.COUNTS], *[F.when(F.col("bad"), 200 if r == "symbols" else 0).otherwise(0).cast("long").alias(r) for r in quality.RULES])
    monkeypatch.setattr(quality, "measures", lambda *rest: measured)
    labels = marked.select(F.col("id").alias("doc_id"), F.when(F.col("bad"), 0).otherwise(1).alias("quality"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    gone = quality.judge(docs, labels).where("not kept").select("doc_id", "rejected_by").collect()
    assert sorted(r["doc_id"] for r in gone) == few and all(r["rejected_by"] == ["symbols"] for r in gone)
