from pyspark.sql import functions as F

from inkloom.llm.mixing import mix, mix_report, rate_for

TARGETS = "mix_name string, source string, target_share double, max_repeats int, size_ratio double, tokens long"


def sizes(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.expr("case when id % 40 = 0 then 'small' when id % 41 = 0 then null else 'big' end").alias("source"), (F.col("id") % 50 + 1).alias("tokens"))


def test_shares_caps_and_report(spark):
    targets = spark.createDataFrame([("m", "small", 0.04, 3, 0.5, 0), ("m", "big", 0.96, 2, 0.5, 0), ("n", "small", 1.0, 2, 0.5, 0), ("n", "none", 0.1, None, 0.5, 0), ("n", None, 0.2, 1, 0.5, 0)], TARGETS)
    s = sizes(spark)
    drawn = mix(s, targets).cache()
    total = s.agg(F.sum("tokens")).first()[0]
    by = {(r["mix_name"], r["source"]): r for r in mix_report(drawn, targets).collect()}
    assert abs(by["m", "small"]["tokens"] - 0.04 * 0.5 * total) / (0.04 * 0.5 * total) < 0.05
    assert abs(by["m", "big"]["tokens"] - 0.96 * 0.5 * total) / (0.96 * 0.5 * total) < 0.01
    small = s.filter("source = 'small'").agg(F.sum("tokens"), F.count("*")).first()
    assert by["n", "small"]["tokens"] == 2 * small[0] and by["n", "small"]["copies"] == 2 * small[1]
    assert by["n", "none"]["tokens"] == 0 and drawn.filter("source is null").count() == 0
    assert drawn.groupBy("mix_name", "doc_id").count().join(drawn, ["mix_name", "doc_id"]).filter("count <> repeats").count() == 0
    assert drawn.filter("mix_name = 'm' and repeats > 3").count() == 0
    assert sorted(drawn.collect()) == sorted(mix(s, targets).collect())


def test_rates_invert_the_distribution():
    import numpy as np

    u = np.array([0.05, 0.5, 0.9])
    for k in (1, 2, 5):
        rate = rate_for(k, u)
        term, total = np.exp(-rate), np.exp(-rate)
        for i in range(1, k):
            term = term * rate / i
            total = total + term
        assert np.allclose(total, u, atol=1e-6)


def test_empty(spark):
    targets = spark.createDataFrame([("m", "small", 0.5, 3, 0.5, 0)], TARGETS)
    assert mix(sizes(spark, 0), targets).count() == 0
    assert mix(sizes(spark, 10), targets.limit(0)).count() == 0
    assert mix(sizes(spark, 10).withColumn("tokens", F.lit(None).cast("long")), targets).count() == 0
