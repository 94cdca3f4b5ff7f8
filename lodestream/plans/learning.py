"""Machine-learning pipelines on Spark's own stages and models, and a custom transformer."""

from __future__ import annotations

from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import HashingTF, Imputer, OneHotEncoder, StringIndexer, Tokenizer, VectorAssembler, VectorIndexer, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.once import spread
from lodestream.plans import relational
from lodestream.sources import bucketed
from lodestream.sources.shared import new_folder
from lodestream.streaming import joins, scoring

QUERIES, ORACLES = {}, {}

#: Estimated bytes of a file that a task of a tree's training gets: its cached points take many times as much.
TREE_PIECE = 1 << 20


def query(sql=None):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return register


class SplitExplode(Transformer, HasInputCol, HasOutputCol):
    """A row for each separated part of the input column."""

    def __init__(self, inputCol: str, outputCol: str, separator: str = ","):
        super().__init__()
        self.separator = separator
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), F.explode(F.split(self.getInputCol(), f"\\Q{self.separator}\\E")))


def _halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Three quarters and the rest, by a hash of the key: the same rows in every run."""
    part = F.pmod(F.xxhash64(key), F.lit(4))
    return df.where(part != 0), df.where(part == 0)


@query("SELECT part, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS part FROM part) GROUP BY 1")
def transformer_flat_map(part):
    return SplitExplode("p_type", "part", " ").transform(part.select("p_type")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem""")
def ml_linear_regression(lineitem):
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(lineitem.select("l_quantity", "l_extendedprice"))
    model = LinearRegression(labelCol="l_extendedprice", solver="normal").fit(data)
    return lineitem.sparkSession.createDataFrame([(round(float(model.coefficients[0]), 4), round(float(model.intercept), 3))], "slope double, intercept double")


def _order_stages():
    index = StringIndexer(inputCol="o_orderpriority", outputCol="priority", handleInvalid="keep")
    return [index, OneHotEncoder(inputCol="priority", outputCol="onehot"), VectorAssembler(inputCols=["onehot", "o_totalprice"], outputCol="features")]


@query()
def ml_logistic_cross_validation(orders):
    """Area under the curve by regularisation, from three folds, and on held-out orders."""
    data = orders.withColumn("label", (F.col("o_orderstatus") == "F").cast("double"))
    train, test = _halves(data, "o_orderkey")
    model = LogisticRegression(maxIter=10)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 0.1]).build()
    judge = BinaryClassificationEvaluator()
    fitted = CrossValidator(estimator=Pipeline(stages=[*_order_stages(), model]), estimatorParamMaps=grid, evaluator=judge, numFolds=3, seed=1, parallelism=2).fit(train)
    rows = [(f"fold mean, regParam {p[model.regParam]}", float(m)) for p, m in zip(grid, fitted.avgMetrics, strict=True)]
    return orders.sparkSession.createDataFrame([*rows, ("held out", float(judge.evaluate(fitted.transform(test))))], "what string, auc double")


@query()
def ml_forest_importances(orders):
    """The weight of each feature of a random forest."""
    data = orders.withColumn("label", (F.col("o_orderstatus") == "F").cast("double"))
    fitted = Pipeline(stages=[*_order_stages(), RandomForestClassifier(numTrees=10, seed=1)]).fit(data)
    weights = fitted.stages[-1].featureImportances.toArray().tolist()
    return orders.sparkSession.createDataFrame(list(enumerate(weights)), "feature int, importance double")


@query()
def ml_boosted_regression(lineitem):
    """Root mean square error of boosted trees on held-out lines."""
    data = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(spread(lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice"), TREE_PIECE))
    train, test = _halves(data, "l_orderkey")
    scored = GBTRegressor(labelCol="l_extendedprice", maxIter=5, seed=1).fit(train).transform(test)
    error = RegressionEvaluator(labelCol="l_extendedprice").evaluate(scored)
    return lineitem.sparkSession.createDataFrame([(float(error),)], "rmse double")


@query()
def ml_scored_rows(orders):
    """A fitted pipeline applied to every order."""
    data = orders.withColumn("label", (F.col("o_orderstatus") == "F").cast("double"))
    fitted = Pipeline(stages=[*_order_stages(), LogisticRegression(maxIter=5)]).fit(data)
    return fitted.transform(data).select("o_orderkey", F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "prediction")


_LINE = "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)"


def _saved_line(lineitem):
    """The folder of a fitted pipeline: price by quantity."""
    stages = [VectorAssembler(inputCols=["l_quantity"], outputCol="raw"), VectorSizeHint(inputCol="raw", size=1), VectorAssembler(inputCols=["raw"], outputCol="features"), LinearRegression(labelCol="l_extendedprice", solver="normal")]
    return scoring.save(Pipeline(stages=stages).fit(lineitem), f"{new_folder(lineitem.sparkSession, 'model')}/line")


@query(f"{_LINE} SELECT l_orderkey, l_linenumber, round(a * l_quantity + b, 2) AS p FROM lineitem, f")
def ml_saved_scores(lineitem):
    """Every line scored by a pipeline that was saved and loaded in another session."""
    model = scoring.load(lineitem.sparkSession.newSession(), _saved_line(lineitem))
    return model.transform(lineitem).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("p"))


@query(f"{_LINE} SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, count(*) AS n, round(avg(a * l_quantity + b), 3) AS mean FROM lineitem, f GROUP BY 1")
def ml_stream_scores(lineitem):
    """The loaded pipeline on a stream of lines: daily means, merged batch by batch into a table, with restarts."""
    spark, folder = lineitem.sparkSession, new_folder(lineitem.sparkSession, "scored-stream")
    model = scoring.load(spark, _saved_line(lineitem))
    cuts = joins.time_cuts([(lineitem, "l_shipdate")], 3)
    for number in range(len(cuts) + 1):
        joins.part_of(lineitem, "l_shipdate", cuts, number).write.mode("append").parquet(f"{folder}/lines")
        arrived = spark.readStream.schema(lineitem.schema).parquet(f"{folder}/lines")
        days = scoring.scores_by_window(model, arrived, "l_shipdate", "1 day")
        bucketed.upsert_stream(days, f"{folder}/days", "start", f"{folder}/checkpoint", buckets=8).awaitTermination()
    return bucketed.read(spark, f"{folder}/days").select(F.col("start").cast("timestamp_ntz").alias("day"), "n", F.round("mean", 3).alias("mean"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def ml_generalized_linear(lineitem):
    """With a normal family and the identity link it is the least-squares line."""
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(lineitem.select("l_quantity", "l_extendedprice"))
    model = GeneralizedLinearRegression(family="gaussian", link="identity", labelCol="l_extendedprice").fit(data)
    return lineitem.sparkSession.createDataFrame([(round(float(model.coefficients[0]), 4), round(float(model.intercept), 3))], "slope double, intercept double")


@query("""WITH r AS (SELECT o_orderstatus = 'F' AS good, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS place FROM orders),
  c AS (SELECT sum(CASE WHEN good THEN place ELSE 0 END) AS s, count(*) FILTER (good) AS p, count(*) FILTER (NOT good) AS q FROM r)
  SELECT round(CAST((s - p * (p + 1) / 2.0) / (p * q) AS DOUBLE), 6) AS auc FROM c""")
def ml_area_under_curve(orders):
    """How well the price alone tells finished orders from others, with all thresholds."""
    data = orders.select(F.col("o_totalprice").alias("rawPrediction"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    return orders.sparkSession.createDataFrame([(round(float(BinaryClassificationEvaluator(numBins=0).evaluate(data)), 6),)], "auc double")


@query()
def ml_decision_trees(part):
    """Trees on imputed numbers and hashed words: weighted precision of the brand's first digit, error of the price."""
    data = spread(part.select("p_partkey", "p_size", "p_type", "p_retailprice", "p_brand"), TREE_PIECE).select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("size"), "p_type", F.col("p_retailprice").alias("price"), F.regexp_extract("p_brand", "[0-9]", 0).alias("brand"))
    features = [
        Imputer(inputCols=["size"], outputCols=["size_filled"], strategy="median"), Tokenizer(inputCol="p_type", outputCol="words"), HashingTF(inputCol="words", outputCol="hashed", numFeatures=64),
        VectorAssembler(inputCols=["size_filled", "hashed"], outputCol="raw"), VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4, handleInvalid="keep"),
    ]
    train, test = _halves(data, "p_partkey")
    classes = Pipeline(stages=[*features, StringIndexer(inputCol="brand", outputCol="label"), DecisionTreeClassifier(maxDepth=4, seed=1)]).fit(train)
    prices = Pipeline(stages=[*features, DecisionTreeRegressor(labelCol="price", maxDepth=4, seed=1)]).fit(train)
    precision = MulticlassClassificationEvaluator(metricName="weightedPrecision").evaluate(classes.transform(test))
    error = RegressionEvaluator(labelCol="price").evaluate(prices.transform(test))
    return part.sparkSession.createDataFrame([("weighted precision of brand", float(precision)), ("rmse of price", float(error))], "what string, value double")
