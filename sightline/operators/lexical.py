"""Lexical model lane: n-gram weights, relational scoring, training, and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.ranges import running
from sightline.operators.relate import stored


def ngrams(text: str, sizes: tuple[int, ...] = (2, 3, 4, 5)) -> Column:
    """All character n-grams of a text, with repeats."""
    c = F.col(text)

    def of(n: int):
        return F.when(F.char_length(c) >= n, F.transform(F.sequence(F.lit(1), F.char_length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in sizes))


def score_grams(rows: DataFrame, weights: DataFrame, identity: str, text: str, bias: float, sizes: tuple[int, ...]) -> DataFrame:
    """Sigmoid of the summed weights of a text's n-grams, by a join with the weight table (gram, weight).

    Counts are summed before the join, so a text's repeated n-grams travel once; texts without a known n-gram score
    the bias. A NULL text scores NULL, never 0.
    """
    grams = rows.where(F.col(text).isNotNull()).select(identity, F.explode(ngrams(text, sizes)).alias("gram")).groupBy(identity, "gram").agg(F.count("*").alias("n"))
    sums = grams.join(weights, "gram").groupBy(identity).agg(F.sum(F.col("n") * F.col("weight")).alias("s"), F.sum("n").alias("known_grams"))
    out = rows.select(identity, text).join(sums, identity, "left")
    score = F.when(F.col(text).isNotNull(), 1 / (1 + F.exp(-(F.lit(bias) + F.coalesce("s", F.lit(0.0))))))
    return out.select(identity, F.round(score, 9).alias("score"), F.when(F.col(text).isNotNull(), F.coalesce("known_grams", F.lit(0))).alias("known_grams"))


def train_lexical(rows: DataFrame, text: str = "text", label: str = "label", vocabulary: int = 150_000, min_df: int = 2, c: float = 2.0):
    """Character 2-5-grams, 1 + ln(tf), smooth idf, L2 norm, class-balanced logistic regression. Returns a fitted pipeline of stages.

    idf here is ln((1 + n) / (1 + df)) + 1; Spark's own has no + 1, so it is put in as element-wise weights.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    rows = rows.withColumn("_grams", ngrams(text))
    counter = CountVectorizer(inputCol="_grams", outputCol="_counts", vocabSize=vocabulary, minDF=min_df).fit(rows)
    counted = counter.transform(rows)
    n = rows.count()
    kept = rows.sparkSession.createDataFrame([(g,) for g in counter.vocabulary], "g string")
    df = dict(counted.select(F.explode(F.array_distinct("_grams")).alias("g")).join(kept, "g", "left_semi").groupBy("g").count().collect())
    import math

    idf = ElementwiseProduct(scalingVec=Vectors.dense([math.log((1 + n) / (1 + df.get(g, 0))) + 1 for g in counter.vocabulary]), inputCol="_tf", outputCol="_tfidf")
    ready = _features(counted, idf)
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    weight = F.lit(1.0)
    for value, size in sizes.items():
        weight = F.when(F.col(label) == value, n / (len(sizes) * size)).otherwise(weight)
    model = LogisticRegression(labelCol=label, weightCol="_weight", regParam=1 / (c * n)).fit(ready.withColumn("_weight", weight))
    return counter, idf, model


def score_model(rows: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """rows with score, result_type and reason by a model of train_lexical.

    Without a model, or without a text to read, a row is ANALYTIC_UNAVAILABLE with a reason and its score is NULL, never 0.
    A text of which the model knows no n-gram scores the model's bias.
    """
    if model is None:
        return rows.withColumns({"score": F.lit(None).cast("double"), "result_type": F.lit("ANALYTIC_UNAVAILABLE"), "reason": F.lit("MODEL_UNAVAILABLE")})
    from pyspark.ml.functions import vector_to_array

    readable = F.coalesce(F.col(text) != "", F.lit(False))
    out = rows.withColumn("_grams", F.when(readable, ngrams(text)).otherwise(F.array().cast("array<string>")))
    counter, idf, fitted = model
    score = vector_to_array(F.col(fitted.getProbabilityCol()))[1]
    scored = fitted.transform(_features(counter.transform(out), idf))
    return scored.select(
        *rows.columns, F.when(readable, score).alias("score"), F.when(readable, "REVIEW_FINDING").otherwise("ANALYTIC_UNAVAILABLE").alias("result_type"),
        F.when(~readable, "REPRESENTATION_UNAVAILABLE").alias("reason"),
    )


def _features(counted: DataFrame, idf) -> DataFrame:
    """features of _counts: 1 + ln(tf) of each known n-gram, times its weight, at length 1."""
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = F.transform(vector_to_array("_counts"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))
    return Normalizer(inputCol="_tfidf", outputCol="features").transform(idf.transform(counted.withColumn("_tf", array_to_vector(known))))


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 at a threshold (0 where a denominator is 0), and label counts, in one aggregation."""
    y, p = F.col("label") == 1, F.col("score") >= threshold
    t = scored.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return t.select(
        (tp + fp + fn + tn).alias("rows"), (tp + fn).alias("positive"), F.round(ratio(tp + tn, tp + fp + fn + tn), 9).alias("accuracy"),
        F.round(ratio(tp, tp + fp), 9).alias("precision"), F.round(ratio(tp, tp + fn), 9).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 9).alias("f1"),
    )


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives for each distinct score: what all ranking measures need, however many rows there are."""
    return scored.groupBy("score").agg(F.sum("label").alias("pos"), (F.count("*") - F.sum("label")).alias("neg"))


def auroc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by mid-ranks: ties count half. Ranks run over range partitions of the distinct scores."""
    t = running(_by_score(scored), (), [F.col("score")], up_to="neg")
    below = F.col("up_to") - F.col("neg")
    return t.agg(F.round(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg")), 9).alias("auroc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum of recall steps times precision over distinct descending scores."""
    t = running(_by_score(scored).withColumn("both", F.col("pos") + F.col("neg")), (), [F.desc("score")], tp="pos", all="both")
    return t.agg(F.round(F.sum(F.col("pos") * F.col("tp") / F.col("all")) / F.sum("pos"), 9).alias("average_precision"))


#: Quantiles of a score summary.
QUANTILES = {"q01": 0.01, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99}


def score_quantiles(scored: DataFrame, by: str) -> DataFrame:
    """Rows, interpolated quantiles and the share of scores from 0.5 on, for each split.

    Equal scores are counted together first; running counts over range partitions then say which score stands at a position, so no
    split is held or sorted in one place.
    """
    known = scored.where("score IS NOT NULL")
    sizes = scored.groupBy(by).agg(F.count("*").alias("rows"), F.count("score").alias("n"), F.avg(F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0)).alias("share"))
    t = running(known.groupBy(by, "score").agg(F.count("*").alias("c")), (by,), [F.col("score")], up_to="c")
    t = t.join(F.broadcast(sizes.select(F.col(by).alias("_by"), "n")), F.col(by).eqNullSafe(F.col("_by")))
    place = {n: (F.col("n") - 1) * F.lit(q) for n, q in QUANTILES.items()}
    holds = lambda at: (F.col("up_to") - F.col("c") <= at) & (at < F.col("up_to"))
    ends = [F.max(F.when(holds(f(p)), F.col("score"))).alias(f"{n}_{k}") for n, p in place.items() for k, f in (("low", F.floor), ("high", F.ceil))]
    found = t.groupBy(by).agg(*ends, F.first("n").alias("_n"))
    between = {n: (F.col("_n") - 1) * F.lit(q) for n, q in QUANTILES.items()}
    value = lambda n, p: F.round(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (p - F.floor(p)), 9).alias(n)
    found = found.select(F.col(by).alias("_by"), *(value(n, p) for n, p in between.items()))
    return sizes.join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "rows", *QUANTILES, F.round("share", 9).alias("share_from_half"))


def model_delta(rows: DataFrame, samples: int) -> DataFrame:
    """Differences of two scores on evenly spaced rows in the order of their key. rows: key, old, new.

    Keys are range-partitioned; only one row for each partition meets in a single task.
    """
    parts = stored(rows.repartitionByRange("key").withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    starts = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_start"))
    n = parts.count()
    step = max(1, n // samples)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("key"))
    ranked = parts.withColumn("_i", inside).join(F.broadcast(starts), "_part").withColumn("_n", F.col("_start") + F.col("_i") - 1)
    return ranked.where((F.col("_n") % step == 0) & (F.floor(F.col("_n") / step) < samples)).select("key", "old", "new", F.round(F.col("new") - F.col("old"), 9).alias("delta"))
