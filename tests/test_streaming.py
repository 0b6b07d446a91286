from __future__ import annotations

from pyspark.sql import functions as F

from laudarium.session import table
from laudarium.streaming import counts


def test_counts_of_a_stream_are_those_of_a_batch(spark, sf_dir, tmp_path):
    batch = table(spark, sf_dir, "parsed_tokens")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = counts.lemma_counts(stream, "3650 days", "3650 days").writeStream.format("memory").queryName("lemmas").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.lemma: r.n for r in spark.sql("select lemma, sum(n) as n from lemmas group by lemma").collect()}
    once = batch.where("lemma is not null").dropDuplicates(["section_id", "par_n", "tok_n", "lemma"]).groupBy("lemma").agg(F.count("*").alias("n"))
    assert got == {r.lemma: r.n for r in once.collect()}


def test_year_counts_run_as_a_batch_too(spark, sf_dir):
    assert counts.year_counts(table(spark, sf_dir, "edition_rows")).where("n > 0").count() > 0
