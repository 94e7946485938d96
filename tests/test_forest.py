"""Binned forest: few jobs, growth on cells, agreement with Spark ML's forest."""

import random

import numpy as np
from pyspark.sql import functions as F

from logsleuth.operators import classify as CL, forest as FO
from logsleuth.sources import models


def _alerts(spark, n=3000):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        score, hour = round(rnd.random(), 3), rnd.randrange(24)
        kind = "a" if score < 0.3 else "b" if hour < 8 else rnd.choice(["b", "c", "c", "d"])
        rows.append(("s", i, score, 3 + (kind == "d" and rnd.random() < 0.8), 75.0 if i % 2 else round(score * 100, 1),
                     hour, None if i % 5 == 0 else i % 2, kind))
    return spark.createDataFrame(rows, "log_type string, row_id int, anomaly_score double, severity int, "
                                       "confidence double, hour int, is_external_ip int, attack_type string").cache()


def test_classifier_is_fitted_in_few_jobs_and_agrees_with_spark_ml(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    alerts = _alerts(spark)
    spark.sparkContext.setJobGroup("fit", "fit")
    model = CL.fit_classifier(alerts)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) < 30   # a job for each level of the trees would be more
    assert CL.predict(model, alerts).columns == alerts.columns + ["predicted_attack_type", "classification_confidence"]
    models.save_classifier(model, str(tmp_path / "forest"))
    model = models.load_classifier(spark, str(tmp_path / "forest"))
    got = {r["row_id"]: r for r in CL.predict(model, alerts).collect()}
    assert len(got) == alerts.count()

    df, cols = CL._prepared(alerts)
    train = CL.split_column(df).where(~F.col("_test"))
    both = VectorAssembler(inputCols=cols, outputCol="x").transform(df)
    learn = VectorAssembler(inputCols=cols, outputCol="x").transform(train)
    index = StringIndexer(inputCol="attack_type", outputCol="y", stringOrderType="alphabetAsc").fit(learn)
    ml = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=100, seed=42, maxDepth=30, maxBins=64,
                                featureSubsetStrategy="sqrt").fit(index.transform(learn)).transform(both)
    want = ml.select("row_id", "prediction", F.array_max(vector_to_array("probability")).alias("p")).collect()
    names = index.labelsArray[0]
    same = np.mean([names[int(r["prediction"])] == got[r["row_id"]]["predicted_attack_type"] for r in want])
    apart = np.mean([abs(100 * r["p"] - got[r["row_id"]]["classification_confidence"]) for r in want])
    assert same > 0.95 and apart < 5, (same, apart)


def test_cells_stand_for_all_rows(spark):
    """Forty copies of the rows make as many cells, with forty times the counts."""
    one = _alerts(spark, 500).select("attack_type", F.col("hour").cast("double").alias("h"), F.col("anomaly_score").alias("s"))
    many = one.crossJoin(spark.range(40)).drop("id")
    few, more = (FO.fit_forest(df, "attack_type", ["h", "s"], list("abcd"), 4, 30, 64, 1) for df in (one, many))
    assert abs(len(few.splits["s"]) - len(more.splits["s"])) <= 2 and few.splits["h"] == more.splits["h"]
    assert few.splits["h"] == [h + 0.5 for h in range(23)]
    assert more.nodes.where("feature < 0").count() < 24 * 64 * 4   # leaves of four trees


def test_tree_reaches_pure_leaves_and_merges_alike():
    cells = np.array([[i, j] for i in range(8) for j in range(8)])
    counts = np.array([[100, 0] if i < 4 or j < 2 else [0, 100] for i, j in cells])
    tree = FO.grow(cells, counts, 0, 3, 30)
    assert (FO.walk(tree, cells).argmax(1) == counts.argmax(1)).all()
    assert len(tree) <= 2 * 6 - 1   # without merging or with cuts inside a class there are more
    assert len(FO.grow(cells, counts, 0, 3, 1)) <= 3


def test_repeated_value_has_a_bin_of_its_own(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 75.0).otherwise(F.col("id") / 40).alias("x"))
    bins, names = FO.binned(df, FO.find_splits(df, ["x"], 64))
    own = bins.where("x = 75").select(names[0]).distinct().collect()
    assert len(own) == 1 and bins.where(F.col(names[0]) == own[0][0]).where("x <> 75").count() == 0


def test_no_rows_to_predict_and_tasks_without_rows(spark):
    from logsleuth.operators import ocsvm as OC
    alerts = _alerts(spark, 300)
    rows = CL._prepared(alerts)[0]
    model = FO.fit_forest(rows.select("attack_type", "_f_hour"), "attack_type", ["_f_hour"], list("abcd"), 3, 5, 64, 1)
    assert FO.predict(model, rows.limit(0), "p", "c").collect() == []
    z = spark.range(200).select("id", (F.col("id") % 7 - 3.0).alias("x")).repartition(4).where("id < 400")
    z = z.union(z.where("id < 0"))   # four tasks have no rows
    assert OC.fit_ocsvm(z, ["x"], steps=1).count() == 1
