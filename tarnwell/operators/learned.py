"""Learned operators on Spark ML: preparation, logistic and tree models, calibration, clusters and their agreement."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Bucketizer, Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.tables import scratch_folder, settled

from .interpret import tree_nodes
from .ordering import exact_quantiles
from .quantiles import grouped_quantiles


#: Rows of different values that one task of a boosted fit takes.
_CELLS = 50_000

#: Rows that one task of a clustering holds.
_ROWS = 250_000


def as_text(df: DataFrame, categorical: list[str]) -> DataFrame:
    """The frame with categories as text, null as the value <missing>."""
    for x in categorical:
        df = df.withColumn(x, F.coalesce(F.col(x).cast("string"), F.lit("<missing>")))
    return df


def prepare(categorical: list[str], numeric: list[str], scale: bool = True) -> list:
    """Stages: median fill, frequency-indexed one-hot with a place for the unseen, standardised numbers."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"_i_{c}" for c in numeric])] if numeric else []
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"_x_{c}" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_x_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], dropLast=False)]
    if numeric:
        stages.append(VectorAssembler(inputCols=[f"_i_{c}" for c in numeric], outputCol="_numbers"))
        if scale:
            stages.append(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True))
    parts = (["_scaled" if scale else "_numbers"] if numeric else []) + [f"_o_{c}" for c in categorical]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def fit_classifier(train: DataFrame, kind: str, target: str, categorical: list[str], numeric: list[str], c: float = 1.0, seed: int = 42, **options) -> PipelineModel:
    """logistic (L2 strength 1 / (c n)), gbt or forest on training rows alone."""
    n = train.count()
    made = {
        "logistic": lambda: LogisticRegression(labelCol=target, regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=200, **options),
        "gbt": lambda: GBTClassifier(labelCol=target, seed=seed, **options),
        "forest": lambda: RandomForestClassifier(labelCol=target, seed=seed, **options),
    }[kind]()
    return Pipeline(stages=[*prepare(categorical, numeric), made]).fit(as_text(train, categorical))


def tree_cuts(df: DataFrame, column: str, seed: int = 42) -> list[float]:
    """The thresholds between which Spark's trees choose for a standardised number, in ascending order; none for a constant.

    A regression tree of the column on itself, deep enough, splits at each of them. Spark draws the rows for its thresholds by the seed and the
    partitions of the frame, so they are those of any tree model with this seed on the same frame.
    """
    rows = VectorAssembler(inputCols=[column], outputCol="_one").transform(df.select(column))
    model = DecisionTreeRegressor(featuresCol="_one", labelCol=column, maxDepth=30, seed=seed).fit(rows)
    nodes = tree_nodes(PipelineModel(stages=[model]), scratch_folder(df.sparkSession, "cuts"))
    return sorted(r["threshold"] for r in nodes.filter("feature is not null").select("threshold").collect())  # one less than bins at most


def fit_boosted(train: DataFrame, validation: DataFrame, target: str, categorical: list[str], numeric: list[str], iterations: int = 500, depth: int = 6, rate: float = 0.04, seed: int = 42) -> PipelineModel:
    """Boosted trees: all iterations are fitted, then as many kept as have the least loss on the validation rows (all without such rows).

    Trees see of a number only between which of Spark's thresholds it lies. So numbers are cut at these first, and rows with equal values are one row
    with their count as weight: the trees are those of the rows themselves, up to rounding, but a step costs no more for more rows of each kind.
    Spark's own early stopping ends at the first iteration without gain, so the best number is looked up in the whole run. Fewer trees
    are fitted again: a model cut to its first trees can't be made without its internals.
    """
    spark = train.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():  # a long run needs its lineage cut
        spark.sparkContext.setCheckpointDir(scratch_folder(spark, "trees"))
    ready = as_text(train, categorical)
    stages = Pipeline(stages=[x for x in prepare(categorical, numeric)[:-1] if not isinstance(x, OneHotEncoder)]).fit(ready).stages
    bins, codes = [f"_b_{c}" for c in numeric], [f"_x_{c}" for c in categorical]
    if numeric:
        numbers = [f"_s_{c}" for c in numeric]
        scaled = [f"(`_i_{c}` - {m!r}D) * {1 / s if s else 0.0!r}D AS `{x}`" for c, x, m, s in zip(numeric, numbers, stages[-1].mean.tolist(), stages[-1].std.tolist())]
        stages = [*stages, SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")]
        known = PipelineModel(stages=stages).transform(ready)
        cuts = [tree_cuts(known, x, seed) or [0.0] for x in numbers]
        # a value at a threshold goes left in a tree, and into the upper bucket here
        splits = [[-math.inf, *(math.nextafter(t, math.inf) for t in x), math.inf] for x in cuts]
        stages = [*stages, Bucketizer(splitsArray=splits, inputCols=numbers, outputCols=bins)]

    def cells(df: DataFrame) -> DataFrame:
        kinds = PipelineModel(stages=stages).transform(df).groupBy(F.col(target).cast("double").alias(target), *bins, *codes).agg(F.count("*").cast("double").alias("_rows"))
        return settled(kinds.select(target, *[F.col(c).alias(c, metadata={}) for c in bins], *codes, "_rows"), "cells")  # buckets are not categories

    table = cells(ready)
    coded = [OneHotEncoder(inputCols=codes, outputCols=[f"_o_{c}" for c in categorical], dropLast=False)] if codes else []
    shaped = Pipeline(stages=[*coded, VectorAssembler(inputCols=bins + [f"_o_{c}" for c in categorical], outputCol="features")]).fit(table)
    n_cells = table.count()
    parts = n_cells // _CELLS + 1  # few: a tree is several jobs, so tasks cost more than cells
    features = shaped.transform(table.repartition(parts, *bins, *codes).sortWithinPartitions(target, *bins, *codes))
    most = max(32, math.isqrt(n_cells) + 1)  # Spark takes its thresholds from all of up to this many cells squared
    fit = lambda n: GBTClassifier(labelCol=target, weightCol="_rows", seed=seed, maxIter=n, maxDepth=depth, stepSize=rate, maxBins=most).fit(features)
    model = fit(iterations)
    if not validation.isEmpty():
        losses = model.evaluateEachIteration(shaped.transform(cells(as_text(validation, categorical))))
        best = 1 + min(range(len(losses)), key=lambda k: losses[k])
        model = model if best == iterations else fit(best)
    return PipelineModel(stages=[*stages, *shaped.stages, model])


def feature_names(model: PipelineModel, df: DataFrame, categorical: list[str], numeric: list[str]) -> list[str]:
    """Names of the entries of a fitted model's feature vector: numbers first, then each category's values, the last one for the unseen."""
    names = list(numeric)
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            for c, labels in zip(categorical, stage.labelsArray):
                names += [f"{c}={x}" for x in labels] + [f"{c}=?"]
    return names


def fit_logistic(train: DataFrame, target: str, categorical: list[str], numeric: list[str], c: float = 1.0, most_values: int = 1000) -> Column:
    """The probability of a logistic model (L2 strength 1 / (c n)) as one expression over the columns.

    Medians, means and spreads of numbers and the values of categories (the `most_values` most frequent) come from aggregates; the model is fitted
    on a written table of its features, and nothing of it but numbers is in the expression.
    """
    medians = exact_quantiles(train, numeric, [0.5]) if numeric else {}
    fill = {x: (medians[x] or [0.0])[0] for x in numeric}
    filled = {x: F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(fill[x])) for x in numeric}
    row = train.agg(F.count("*"), *[a for x in numeric for a in (F.avg(filled[x]), F.stddev_samp(filled[x]))]).first()
    terms = [(filled[x] - F.lit(row[1 + 2 * k] or 0.0)) / F.lit(row[2 + 2 * k] or 1.0) for k, x in enumerate(numeric)]
    for x in categorical:
        text = F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("<missing>"))
        values = train.groupBy(text.alias("v")).count().orderBy(F.desc("count"), "v").limit(most_values).collect()
        terms += [(text == F.lit(v["v"])).cast("double") for v in values]
    table = settled(train.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("label"), array_to_vector(F.array(*terms)).alias("features")), "features")
    model = LogisticRegression(regParam=1.0 / (c * max(row[0], 1)), standardization=False, maxIter=200).fit(table)
    z = F.lit(float(model.intercept))
    for weight, term in zip(model.coefficients.toArray().tolist(), terms):
        z = z + F.lit(weight) * term
    return 1 / (1 + F.exp(-z))


def predict(model: PipelineModel, df: DataFrame, categorical: list[str], name: str = "p") -> DataFrame:
    """The frame with the probability of class 1."""
    return model.transform(as_text(df, categorical)).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def platt(validation: DataFrame, df: DataFrame, target: str, p: str, name: str = "calibrated") -> DataFrame:
    """Scores recalibrated by a logistic fit on the validation rows' logits; kept only if it lowers their log-loss."""
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    add = lambda d: VectorAssembler(inputCols=["_z"], outputCol="_v").transform(d.withColumn("_z", F.log(clipped / (1 - clipped))))
    model = LogisticRegression(featuresCol="_v", labelCol=target, maxIter=200).fit(add(validation))
    a, b = model.intercept, model.coefficients[0]
    fitted = 1 / (1 + F.exp(-(F.lit(float(a)) + F.lit(float(b)) * F.log(clipped / (1 - clipped)))))
    y = F.col(target).cast("double")
    loss = lambda q: F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))
    before, after = validation.agg(loss(clipped), loss(F.least(F.greatest(fitted, F.lit(1e-6)), F.lit(1 - 1e-6)))).first()
    return df.withColumn(name, fitted if after < before else F.col(p))


def isotonic(validation: DataFrame, df: DataFrame, target: str, p: str, name: str = "calibrated") -> DataFrame:
    model = IsotonicRegression(featuresCol=p, labelCol=target, predictionCol=name).fit(validation.withColumn(target, F.col(target).cast("double")))
    return model.transform(df)


def dealt(df: DataFrame, most: int) -> DataFrame:
    """The frame, its rows dealt out evenly if a task has more than `most`: a file of few row groups would be few tasks."""
    largest, total = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return df.repartition(-(-total // most)) if (largest or 0) > most else df


def cluster(df: DataFrame, kind: str, k: int, categorical: list[str], numeric: list[str], seed: int = 42, components: int | None = None) -> DataFrame:
    """The frame with `profile`: clusters renamed by size, the largest first, ties by their old number.

    A fit holds the features of its rows, so rows are dealt to tasks of at most about `_ROWS` for it. Its random start depends on how rows lie in tasks.
    """
    made = {"kmeans": KMeans, "bisecting": BisectingKMeans, "mixture": GaussianMixture}[kind](k=k, seed=seed, predictionCol="_c")
    stages = prepare(categorical, numeric)
    if components:
        stages.append(PCA(k=components, inputCol="features", outputCol="_pca"))
        made.setFeaturesCol("_pca")
    ready = as_text(df, categorical)
    shaped = Pipeline(stages=stages).fit(ready)
    model = made.fit(shaped.transform(dealt(ready.select(*categorical, *numeric), _ROWS)))
    out = model.transform(shaped.transform(ready))
    sizes = out.groupBy("_c").agg(F.count("*").alias("_n")).withColumn("profile", F.row_number().over(Window.orderBy(F.desc("_n"), "_c")) - 1)
    return out.join(F.broadcast(sizes.select("_c", "profile")), "_c").select(*df.columns, "profile", F.col("_pca" if components else "features").alias("features"))  # one row a cluster


def k_sweep(df: DataFrame, kind: str, ks: list[int], categorical: list[str], numeric: list[str], seed: int = 42) -> DataFrame:
    """k, silhouette, smallest and largest share, and whether the balance gate (>= 5 %, <= 65 %) holds."""
    rows = []
    for k in ks:
        out = cluster(df, kind, k, categorical, numeric, seed).persist()
        shares = [r["count"] for r in out.groupBy("profile").count().collect()]
        total = sum(shares)
        quality = ClusteringEvaluator(predictionCol="profile", featuresCol="features").evaluate(out) if len(shares) > 1 else None
        rows.append((k, quality, min(shares) / total, max(shares) / total, min(shares) / total >= 0.05 and max(shares) / total <= 0.65))
        out.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, smallest double, largest double, balanced boolean")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("sc"), F.sum("n").alias("n"))
    one = both.join(F.broadcast(rows)).join(F.broadcast(cols))  # three single rows
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    return one.select(F.coalesce(F.try_divide(F.col("sc") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def supply_profile(df: DataFrame, entity: str, time_days: str, outcome: Column, kinds: str, values: list, prior: float, strength: float = 20.0) -> DataFrame:
    """Per entity: rows, response rate shrunk to the prior, median lag, mix of kinds, entropy and main kind."""
    from .aggregates import share_entropy, shrunk_rate

    g = df.groupBy(entity).agg(F.count("*").alias("n"), F.count_if(F.coalesce(outcome, F.lit(False))).alias("hits"), *[F.avg((F.col(kinds) == v).cast("double")).alias(f"share_{v}") for v in values])
    middle = grouped_quantiles(df, [entity], time_days, {"median_lag": 0.5}).select(F.col(entity).alias("_entity"), "median_lag")
    g = g.join(middle, g[entity].eqNullSafe(middle["_entity"]), "left").drop("_entity")
    entropy, top = share_entropy([f"share_{v}" for v in values])
    return g.withColumns({"rate": shrunk_rate(F.col("hits"), F.col("n"), prior, strength), "entropy": entropy, "main": top})


def normal_upper_p(z: Column, series: int = 80, fraction: int = 120) -> Column:
    """P(Z >= z) of a standard normal Z.

    Below 3 it is 1/2 less density times the series z + z^3/3 + z^5/(3 5) + ...; from 3 on density over the continued fraction
    z + 1/(z + 2/(z + 3/(z + ...))), both as in Abramowitz and Stegun, Handbook of Mathematical Functions (public domain), 26.2.11 and 26.2.14.
    """
    x = F.abs(z.cast("double"))
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    small = F.least(x, F.lit(3.0))
    start = F.struct(small.alias("term"), small.alias("total"))
    step = lambda a, k: F.struct((a["term"] * small * small / (2 * k + 1)).alias("term"), (a["total"] + a["term"] * small * small / (2 * k + 1)).alias("total"))
    near = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(series)), start, step, lambda a: a["total"])
    far = density / F.aggregate(F.sequence(F.lit(fraction), F.lit(1), F.lit(-1)), x, lambda a, k: x + k / a)
    tail = F.when(x < 3, near).otherwise(far)
    return F.when(z >= 0, tail).otherwise(1 - tail)
