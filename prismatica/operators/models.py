"""Model training, comparison, evaluation, prediction and importance on MLlib."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from prismatica.functions.coerce import col, date_parts
from prismatica.functions.columns import dtype_of, kind_of, moment, number, value
from prismatica.operators.clean import modes
from prismatica.operators.profile import column_facts, problem_type, with_roles
from prismatica.functions.quantiles import Rank, quantiles, ranked

HIGH_CARDINALITY = 0.95
# How text becomes features, at every size alike: a feature per level, kept by the model, or slots
# of a hash, for columns whose levels are too many for a model to keep.
ENCODINGS, SLOTS = ("onehot", "hash"), 2 ** 18
# A pass over the data grows many trees of a forest at once, and each row keeps the node it has reached in each tree:
# following hundreds of trees from their roots again in each pass costs far more than the pass. The trees are the same.
# The statistics of the nodes that a pass grows are in the memory of each task: at most so much, and what fits (`tree_memory`).
TREE_MEMORY_MB = 1024
FOREST = dict(maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=True)
# What Spark keeps for itself of a heap.
RESERVED_MB = 300
PLAIN = ("boolean", "int", "bigint", "double", "string", "date", "timestamp", "timestamp_ntz")
# Rows up to which one task is enough to train on, and the most that one task gets.
TASK_ROWS, MOST_TASK_ROWS = 5_000, 1_000_000


# --- evaluation ------------------------------------------------------------------------

def evaluate_regression(pred: DataFrame, actual: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 of a prediction table, over all rows or per group.

    R2 uses the centred sum of squares the variance keeps, so one pass does."""
    y, e = F.col(actual), F.col(actual) - F.col(prediction)
    total = F.var_pop(y) * F.count(y)
    return pred.groupBy(*(by or [])).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), total)).alias("r2"), F.count(y).alias("test_points"))


def evaluate_classification(pred: DataFrame, actual: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, read off the
    confusion table, whose size is classes x classes."""
    cell = (pred.groupBy(F.col(actual).cast("string").alias("a"), F.col(prediction).cast("string").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))
    sides = cell.select(F.inline(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")))))
    per = sides.groupBy("label").agg(F.sum("support").alias("s"), F.sum("predicted").alias("q"), F.sum("hit").alias("h"))
    precision = F.coalesce(F.try_divide(F.col("h"), F.col("q")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("h"), F.col("s")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0))
    weigh = lambda c: F.try_divide(F.sum(c * F.col("s")), F.sum("s"))
    return per.agg(F.try_divide(F.sum("h"), F.sum("s")).alias("accuracy"), weigh(precision).alias("precision"),
                   weigh(recall).alias("recall"), weigh(f1).alias("f1"), F.sum("s").alias("test_points"))


# --- preparation -----------------------------------------------------------------------

@dataclass(frozen=True)
class Preparation:
    """Which columns are features and what fills their gaps."""

    numeric: list[str]
    categorical: list[str]
    fills: dict = field(default_factory=dict)
    scale: bool = False
    hashed: list[str] = field(default_factory=list)

    def _inputs(self, kind: str) -> list[str]:
        """Working names by position: they cannot meet column names, dots included."""
        return [f"m__{kind}{i}" for i in range(len(getattr(self, kind)))]

    def named(self, prefix: str = "") -> list[Column]:
        """The filled features under ``prefix`` and their own names."""
        return [F.col(name).alias(prefix + c) for kind in ("numeric", "categorical", "hashed")
                for c, name in zip(getattr(self, kind), self._inputs(kind))]

    def fill(self, df: DataFrame) -> DataFrame:
        new = [F.coalesce(number(df, c), F.lit(self.fills.get(c, 0.0))).alias(name)
               for c, name in zip(self.numeric, self._inputs("numeric"))]
        new += [F.coalesce(value(df, c).cast("string"), F.lit(self.fills.get(c, ""))).alias(name)
                for kind in ("categorical", "hashed") for c, name in zip(getattr(self, kind), self._inputs(kind))]
        return df.select("*", *new)

    def stages(self) -> list:
        out, inputs = [], self._inputs("numeric")
        if self.scale and inputs:
            out += [VectorAssembler(inputCols=inputs, outputCol="m__plain"),
                    StandardScaler(inputCol="m__plain", outputCol="m__scaled", withMean=True)]
            inputs = ["m__scaled"]
        if self.categorical:
            names = self._inputs("categorical")
            index, hot = [f"{c}_index" for c in names], [f"{c}_hot" for c in names]
            # Unseen labels get the last index, which the encoder drops: all zeros.
            out += [StringIndexer(inputCols=names, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
                    OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]
            inputs = inputs + hot
        if self.hashed:
            out.append(FeatureHasher(inputCols=self._inputs("hashed"), outputCol="m__hashed", numFeatures=SLOTS))
            inputs = inputs + ["m__hashed"]
        return [*out, VectorAssembler(inputCols=inputs, outputCol="m__features")]


def prepare_features(df: DataFrame, target: str, scale: bool = False, keep_constant: bool = False,
                     training: Column | None = None, encoding: str = "onehot", ignore: list[str] | None = None) -> tuple[DataFrame, Preparation]:
    """Rows with a target, and the feature columns worth training on.

    Constant columns and text with more than 95 % distinct values go (with
    ``keep_constant`` only all-missing columns go). Numbers are filled with
    the exact median, text with its mode, both of the ``training`` rows (default:
    all rows). Facts per column reach the driver. Text gets a feature per level
    with ``encoding`` onehot, which the model then keeps, and one of 2^18 slots with
    hash, however many levels it has. Columns in ``ignore`` are no features.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    rows = df.filter(value(df, target).isNotNull())
    numeric, categorical, hashed = [], [], []
    for f in column_facts(rows.select(*[col(c) for c in rows.columns if c != target and c not in (ignore or [])])).orderBy("col_no").collect():
        filled, gap = f["distinct"], f["missing"] > 0
        if filled == 0 or (not keep_constant and filled + gap <= 1):
            continue
        if f["kind"] in ("numeric", "boolean"):
            numeric.append(f["column"])
        elif f["kind"] == "categorical" and (keep_constant or filled / max(f["rows"], 1) <= HIGH_CARDINALITY):
            (hashed if encoding == "hash" else categorical).append(f["column"])
    if not numeric and not categorical and not hashed:
        raise ValueError("no usable feature columns were detected")
    known, fills = rows if training is None else rows.filter(training), {}
    if numeric:
        fills |= {r["column"]: r["q0"] for r in quantiles(known, [(c, number(known, c)) for c in numeric], [0.5]).collect()}
    texts = categorical + hashed
    if texts:
        fills |= {texts[r["col_no"]]: r["s"] for r in modes(known, texts).collect()}
    return rows, Preparation(numeric, categorical, fills, scale, hashed)


def in_training(df: DataFrame, key: list[str] | None = None, test_size: float = 0.2, seed: int = 42) -> Column:
    """Whether a row is a training row, by a hash of its key (default: all columns)."""
    keys = [value(df, c) for c in (key or df.columns)]
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(10_000)) >= int(test_size * 10_000)


def hash_split(df: DataFrame, key: list[str] | None = None, test_size: float = 0.2, seed: int = 42,
               name: str = "is_train") -> DataFrame:
    """Mark rows as train or test by a hash of their key, so the split does
    not move with partitioning and needs no shuffle."""
    return df.withColumn(name, in_training(df, key, test_size, seed))


def _classes(df: DataFrame, target: str) -> list[tuple[str, int]]:
    """(label, rows) of every class, in order of the labels; a row per class reaches the driver, as the models keep one."""
    counted = df.groupBy(value(df, target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("label is not null")
    return sorted((r["label"], r["n"]) for r in counted.collect())


def stratified_split(df: DataFrame, target: str, key: list[str] | None = None, test_size: float = 0.2, seed: int = 42,
                     name: str = "is_train") -> DataFrame:
    """Mark rows as train or test so that every class of ``target`` gives the same share, to the row, and is
    on both sides.

    The test rows of a class are those of its least key hashes, up to the hash at the wanted rank; ranks of all
    classes are found together, without sorting a class in one task. Rows with equal keys stay together, and
    then the share is as near as they allow. If a class has a single row, or there is none, the split is :func:`hash_split`. Rows without
    a class are split by it too.
    """
    classes = _classes(df, target)
    plain = in_training(df, key, test_size, seed)
    if not classes or min(n for _, n in classes) < 2:
        return df.withColumn(name, plain)
    spark, label = df.sparkSession, value(df, target).cast("string")
    keys = [value(df, c) for c in (key or df.columns)]
    place = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(2 ** 53)).cast("double")
    index = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(classes)], "col_no int, m__class string")
    cells = df.select(label.alias("m__class"), place.alias("v")).join(index, "m__class").select("col_no", "v")
    # Halves are rounded up, and each side keeps a row.
    _, found = ranked(cells, [Rank(f"greatest(1, least(n - 1, cast(floor(n * {test_size!r}D + 0.5D) AS bigint))) - 1", test_size)])
    limits = spark.createDataFrame([(c, found[i, 0][0]) for i, (c, _) in enumerate(classes)], "m__class string, m__limit double")
    marked = df.select("*", label.alias("m__class"), place.alias("m__place")).join(limits, "m__class", "left")
    return marked.select(*[col(c) for c in df.columns], F.coalesce(F.col("m__place") > F.col("m__limit"), plain).alias(name))


# --- training --------------------------------------------------------------------------

def training_tasks(spark: SparkSession, n: int) -> int:
    """Into how many tasks ``n`` training rows are dealt: one per core, where each gets enough to do. More tasks
    would only send more tree statistics about."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(cores, -(-n // TASK_ROWS)), -(-n // MOST_TASK_ROWS))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """``df``, of ``n`` rows, dealt evenly over the cores: a table of one file or one row group would be trained on
    by one task, in each of the hundreds of passes. Rows have a fixed order in a task, so a model does not move with
    the shuffle. A table that one task is enough for stays as it is."""
    if n <= TASK_ROWS:
        return df
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if t in PLAIN]
    return df.repartition(training_tasks(df.sparkSession, n)).sortWithinPartitions(F.xxhash64(*plain), *plain)


def executor_heap(spark: SparkSession) -> tuple[float, int, int]:
    """MB of an executor's heap, the tasks that run side by side in it, and the number of executors."""
    sc = spark.sparkContext
    local = re.fullmatch(r"local(?:\[(\d+|\*).*\])?", sc.master)
    if local:
        jvm = sc._jvm.java.lang.Runtime.getRuntime()
        cores = jvm.availableProcessors() if local[1] == "*" else int(local[1] or 1)
        return jvm.maxMemory() / 2 ** 20, cores, 1
    conf = sc.getConf()
    executors = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is one of them
    cores = int(conf.get("spark.executor.cores", "0")) or -(-sc.defaultParallelism // executors)
    return float(sc._jsc.sc().executorMemory()), max(1, cores // int(conf.get("spark.task.cpus", "1"))), executors


def tree_memory(data: DataFrame, n: int, trees: int, features: int) -> int:
    """MB that the statistics of the nodes grown in a pass may take in each task: half of what the ``n`` cached rows leave
    of an executor's heap, shared by the tasks that run side by side. A row keeps its bins, its weight in each tree and
    three generations of the nodes it has reached; cached rows beyond Spark's share of the heap go to disk."""
    spark = data.sparkSession
    heap, slots, executors = executor_heap(spark)
    usable = max(heap - RESERVED_MB, heap / 3)
    share = float(spark.sparkContext.getConf().get("spark.memory.fraction", "0.6"))
    kept = min(share * usable, n * 4 * (4 * trees + features) / 2 ** 20 / executors)
    return max(1, min(TREE_MEMORY_MB, int((usable - kept) / 2 / min(slots, max(1, data.rdd.getNumPartitions())))))


@dataclass
class Trained:
    """The compared models of one target."""

    problem_type: str
    target: str
    best_model: str
    pipeline: PipelineModel
    labels: list[str] | None
    preparation: Preparation
    comparison: DataFrame
    predictions: DataFrame
    score_name: str
    kept: list = field(default_factory=list)

    def release(self) -> None:
        """Give back what the lazy predictions read; the model stays."""
        for df in self.kept:
            df.unpersist()


def _candidates(problem: str, classes: int, trees: int, depth: int, variant: str, seed: int, memory: int = TREE_MEMORY_MB) -> dict:
    """The estimators by name; ``memory``: MB of a task that a forest may take for its statistics."""
    forest = FOREST | dict(maxMemoryInMB=memory)
    boost = dict(maxIter=200, stepSize=0.05, maxDepth=3) if variant == "b" else dict(maxIter=100, stepSize=0.1, maxDepth=3)
    common = dict(featuresCol="m__features", labelCol="m__label", predictionCol="m__prediction")
    if problem == "regression":
        return {"Linear Regression": LinearRegression(**common),
                "Random Forest": RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all",
                                                       **forest, **common),
                "Gradient Boosting": GBTRegressor(seed=seed, **boost, **common)}
    chance = dict(probabilityCol="m__probability", rawPredictionCol="m__raw")
    gbt = GBTClassifier(seed=seed, **boost, **common)
    gbt = gbt.setProbabilityCol("m__probability").setRawPredictionCol("m__raw")
    return {"Logistic Regression": LogisticRegression(maxIter=2000, **common, **chance),
            "Random Forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt",
                                                    **forest, **common, **chance),
            "Gradient Boosting": gbt if classes == 2 else OneVsRest(
                classifier=gbt, rawPredictionCol="m__raw", **common)}


def train_compare(df: DataFrame, target: str, test_size: float = 0.2, seed: int = 42, key: list[str] | None = None,
                  variant: str = "a", trees: int = 250, max_depth: int = 12, encoding: str = "onehot") -> Trained:
    """Fit linear, forest and boosted models and keep the best on the holdout.

    Variant ``a`` needs 10 rows and ranks by R2 or accuracy; ``b`` needs 20,
    scales numbers and ranks by R2 or weighted F1. Classes are split evenly
    (:func:`stratified_split`). A model that fails is reported with its error
    and the others go on.
    """
    spark = df.sparkSession
    least = 20 if variant == "b" else 10
    usable = df.filter(value(df, target).isNotNull())
    if usable.limit(least).count() < least:
        raise ValueError(f"at least {least} rows are needed for training")
    kind = problem_type(usable, target, any_non_numeric=variant == "b").first()["problem_type"]
    labels = None
    if kind == "classification":
        labels = [c for c, _ in _classes(usable, target)]
        if len(labels) < 2:
            raise ValueError("classification requires at least two target classes")
        split = stratified_split(usable, target, key, test_size, seed, "m__train")
        numbers = spark.createDataFrame([(c, float(i)) for i, c in enumerate(labels)], "m__class string, m__label double")
        split = split.withColumn("m__class", value(split, target).cast("string")).join(numbers, "m__class").drop("m__class")
    else:
        split = hash_split(usable, key, test_size, seed, "m__train").withColumn("m__label", number(usable, target))
    rows, prep = prepare_features(split, target, scale=variant == "b", keep_constant=variant == "b", training=F.col("m__train"),
                                  encoding=encoding, ignore=["m__train", "m__label"])
    ready = prep.fill(rows)
    encoder = Pipeline(stages=prep.stages()).fit(ready.filter("m__train"))
    n = ready.count()
    data = dealt(encoder.transform(ready), n).persist()
    train, test = data.filter("m__train"), data.filter("not m__train")
    score = "r2" if kind == "regression" else ("f1" if variant == "b" else "accuracy")
    figures = ["mae", "rmse", "r2"] if kind == "regression" else ["accuracy", "precision", "recall", "f1"]
    def tried(candidate):
        name, estimator = candidate
        try:
            model = estimator.fit(train)
            pred = _scored(model, test)
            got = (evaluate_regression(pred, "m__label", "m__prediction") if kind == "regression"
                   else evaluate_classification(pred, "m__label", "m__prediction")).first()
            return model, (name, *[got[f] for f in figures], "Success", None)
        except Exception as failure:  # the comparison reports it
            return None, (name, *[None] * len(figures), "Failed", str(failure))

    # The boosting is hundreds of short jobs in a row, the forest a few long ones: each uses the cores the other leaves.
    memory = tree_memory(data, n, trees, data.schema["m__features"].metadata["ml_attr"]["num_attrs"])
    candidates = _candidates(kind, len(labels or []), trees, max_depth, variant, seed, memory)
    with ThreadPool(len(candidates)) as pool:
        tries = pool.map(inheritable_thread_target(spark)(tried), candidates.items(), 1)
    rows_out, fitted = [row for _, row in tries], {row[0]: model for model, row in tries if model is not None}
    schema = "model string, " + ", ".join(f"{f} double" for f in figures) + ", status string, error string"
    comparison = spark.createDataFrame(rows_out, schema)
    at = 1 + figures.index(score)
    valid = [r for r in rows_out if r[-2] == "Success" and r[at] is not None]
    if not valid:
        raise RuntimeError("no model could be trained")
    best = min(valid, key=lambda r: (-r[at], r[0]))[0]
    pipeline = PipelineModel(stages=[*encoder.stages, fitted[best]])
    table = _decoded(_scored(fitted[best], test), labels).select(
        *[col(c) for c in df.columns if c != target], value(rows, target).alias("actual"), F.col("m__prediction").alias("prediction"),
        *([F.col("m__chance").alias("prediction_probability")] if labels and len(labels) == 2 else []))
    return Trained(kind, target, best, pipeline, labels, prep, comparison, table, score, [data])


def _scored(model, data: DataFrame) -> DataFrame:
    """``model.transform(data)``; one-vs-rest models cannot read dotted names, so data columns go through under others."""
    names = data.columns
    out = model.transform(data.toDF(*[c if c.startswith("m__") else f"m__column{i}" for i, c in enumerate(names)]))
    return out.toDF(*names, *out.columns[len(names):])


def _decoded(pred: DataFrame, labels: list[str] | None) -> DataFrame:
    """Predicted class names instead of indexes, and the probability of the
    second class of two."""
    if labels is None:
        return pred
    names = F.array(*map(F.lit, labels))
    if len(labels) == 2:
        pred = pred.withColumn("m__chance", vector_to_array("m__probability")[1])
    return pred.withColumn("m__prediction", F.get(names, F.col("m__prediction").cast("int")))


def predict(trained: Trained, df: DataFrame, name: str = "prediction") -> DataFrame:
    """Every row of ``df`` with the best model's prediction."""
    pred = _decoded(_scored(trained.pipeline, trained.preparation.fill(df)), trained.labels)
    return pred.select(*[col(c) for c in df.columns], F.col("m__prediction").alias(name))


def _feature_labels(trained: Trained) -> list[str]:
    prep, names = trained.preparation, [f"numeric:{c}" for c in trained.preparation.numeric]
    indexer = next((s for s in trained.pipeline.stages if hasattr(s, "labelsArray")), None)
    for c, words in zip(prep.categorical, indexer.labelsArray if indexer is not None else []):
        names += [f"categorical:{c}={w}" for w in words]
    return names


def feature_importance(trained: Trained, n: int | None = 30) -> DataFrame:
    """Features of the best model by importance (tree gain, or absolute
    coefficient averaged over classes) with their share of the total."""
    model, spark = trained.pipeline.stages[-1], trained.comparison.sparkSession
    members = model.models if hasattr(model, "models") else [model]
    if hasattr(members[0], "featureImportances"):
        weights = [m.featureImportances.toArray() for m in members]
    elif hasattr(model, "coefficientMatrix"):
        weights = [abs(row) for row in model.coefficientMatrix.toArray()]
    else:
        weights = [abs(model.coefficients.toArray())]
    mean = sum(weights) / len(weights)
    total = float(mean.sum())
    labels = _feature_labels(trained)
    named = [(name, w) for name, w in zip(labels, mean)]
    # Of the hashed slots only those the model uses are listed.
    named += [(f"hashed:{k - len(labels)}", mean[k]) for k in mean.nonzero()[0] if k >= len(labels)]
    rows = [(name, float(w), float(w) / total * 100 if total else 0.0) for name, w in named]
    out = spark.createDataFrame(rows, "feature string, importance double, importance_pct double").orderBy(
        F.desc("importance"), "feature")
    return out.limit(n) if n else out


def model_summary(trained: Trained) -> DataFrame:
    """One row: problem type, models trained, the best with its score, and its
    five leading features."""
    done = trained.comparison.filter("status = 'Success'")
    best = done.agg(F.count(F.lit(1)).alias("models_trained"),
                    F.max(F.when(F.col("model") == trained.best_model, F.col(trained.score_name))).alias("best_score"))
    top = [r["feature"] for r in feature_importance(trained, 5).collect()]
    return best.select(
        F.lit(trained.target).alias("target"), F.lit(trained.problem_type).alias("problem_type"), "models_trained",
        F.lit(trained.best_model).alias("best_model"), F.lit(trained.score_name).alias("best_score_name"), "best_score",
        F.array(*map(F.lit, top)).alias("top_features"))


# --- permutation importance --------------------------------------------------------------

BLOCK = 2048


def permutation_importance(df: DataFrame, target: str, key: list[str], top_n: int = 15, repeats: int = 8,
                           trees: int = 300, max_depth: int = 12, seed: int = 42) -> DataFrame:
    """(feature, importance, std): mean drop of the holdout score when one
    feature is permuted, over ``repeats`` permutations.

    Holdout rows are dealt into blocks of about 2048 by a hash of ``key``
    (which should be unique) and ordered in the block by another hash. A
    permutation turns one feature's values round the block by an offset of its
    own per repeat, so permuting needs one grouping of bounded blocks and no
    join, and every copy is scored in one pass of the model.
    """
    y = number(df, target)
    share = df.agg(F.avg(y.isNotNull().cast("double"))).first()[0] or 0.0
    regression = share >= 0.8
    rows = df.filter(y.isNotNull()) if regression else df
    n = rows.count()
    empty = df.sparkSession.createDataFrame([], "feature string, importance double, std double")
    if n < 30:
        return empty
    plain = rows.drop(target)
    features: dict[str, Column] = {}
    for fact in with_roles(column_facts(plain)).orderBy("col_no").collect():
        c, role = fact["column"], fact["role"]
        if role == "empty":
            continue
        if role == "date":
            features |= {k: v.cast("double") for k, v in date_parts(moment(rows, c), c).items()}
        elif kind_of(dtype_of(rows, c)) == "numeric":
            features[c] = number(rows, c)
        else:  # a code is only a label to trees: a hash of the text serves, without a table of levels
            features[c] = F.xxhash64(F.coalesce(value(rows, c).cast("string"), F.lit("MISSING"))).cast("double")
    zero = F.lit(0.0)
    base = rows.select(
        F.xxhash64(*[col(k) for k in key], F.lit(seed)).alias("h"),
        *[F.coalesce(v, zero).alias(f"x_{i}") for i, v in enumerate(features.values())],
        (y if regression else F.coalesce(value(rows, target).cast("string"), F.lit("UNKNOWN"))).alias("y"))
    if regression:
        coded = base.withColumn("label", F.col("y"))
    else:
        coded = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(base).transform(base)
    names = list(features)
    spans = coded.agg(*[(F.max(f"x_{i}") > F.min(f"x_{i}")).alias(f"x_{i}") for i in range(len(names))]).first()
    live = [i for i in range(len(names)) if spans[f"x_{i}"]]
    if not live:
        return empty
    inputs = [f"x_{i}" for i in live]
    data = coded.select("h", "label", *inputs, (F.pmod("h", F.lit(10_000)) >= 2_000).alias("is_train"))
    data = dealt(data, n).persist()
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    forest = (RandomForestRegressor if regression else RandomForestClassifier)(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed,
        **FOREST | dict(maxMemoryInMB=tree_memory(data, n, trees, len(inputs))))
    model = forest.fit(assembler.transform(data.filter("is_train")))

    blocks = max(1, int(n * 0.2) // BLOCK)
    turning = (data.filter("not is_train")
               .groupBy(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(blocks)).alias("block"))
               .agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("h", F.lit(2)).alias("o"), "label", *inputs))).alias("m")))
    # Blocks are few bytes, their scored copies much work: each core gets its share of them.
    if n > TASK_ROWS:
        turning = turning.repartition(min(blocks, 4 * df.sparkSession.sparkContext.defaultParallelism))
    # feature -1 is the unpermuted copy, scored once
    plan = F.array(*[F.struct(F.lit(j).alias("feature"), F.lit(r).alias("repeat"))
                     for j, r in [(-1, 0), *[(j, r) for j in range(len(live)) for r in range(repeats)]]])
    # The copies of a row leave one after another: they take nearly the same ways through the trees, so the nodes they
    # pass are still at hand. The block is turned as an array, so its rows leave it once each and none carries the others along.
    turns = F.transform(plan, lambda p: F.struct(
        p["feature"].alias("feature"), p["repeat"].alias("repeat"),
        (F.pmod(F.xxhash64("block", p["feature"], p["repeat"], F.lit(seed)), F.greatest(F.size("m") - 1, F.lit(1))) + 1).alias("turn")))
    there = "m[cast(pmod(i + p.turn, size(m)) AS int)]"
    fields = ", ".join(f"CASE WHEN p.feature = {j} THEN {there}.{x} ELSE row.{x} END AS {x}" for j, x in enumerate(inputs))
    turned = (turning.select("m", turns.alias("plan"))
              .select(F.expr(f"transform(m, (row, i) -> transform(plan, p -> struct(p.feature, p.repeat, row.label AS label, {fields})))").alias("m"))
              .select(F.inline(F.flatten("m"))))
    pred = model.transform(assembler.transform(turned))
    if regression:
        scores = evaluate_regression(pred, "label", "prediction", by=["feature", "repeat"]).select("feature", "repeat", F.col("r2").alias("score"))
    else:
        scores = pred.groupBy("feature", "repeat").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("score"))
    scores = df.sparkSession.createDataFrame(scores.collect(), "feature int, repeat int, score double")  # a row per copy
    data.unpersist()
    whole = scores.filter("feature = -1").select(F.lit(1).alias("one"), F.col("score").alias("whole"))
    titles = F.array(*[F.lit(names[i]) for i in live])
    return (scores.filter("feature >= 0").withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
            .groupBy(F.get(titles, F.col("feature")).alias("feature"))
            .agg(F.avg(F.col("whole") - F.col("score")).alias("importance"),
                 F.stddev_pop(F.col("whole") - F.col("score")).alias("std"))
            .orderBy(F.desc("importance"), "feature").limit(top_n))
