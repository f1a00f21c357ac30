"""The transaction categoriser: word and character TF-IDF, a class-balanced logistic regression, holdouts, choice and storage.

Rows carry ``text`` (see ``training.feature_text``) and ``category_id``. Everything is a Spark ML
pipeline over DataFrames; what reaches the driver is the model, bounded by ``FEATURES`` and the classes.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import training
from ledgerspark.session import cut

#: Terms of each kind that are kept, the most frequent first; rows below which a part is too small.
FEATURES, LEAST_TRAIN, LEAST_TEST = 1 << 16, 20, 5
STAGES = ("CountVectorizer", "IDF", "Normalizer", "CountVectorizer", "IDF", "Normalizer", "VectorAssembler", "StringIndexer", "LogisticRegression", "IndexToString")


def terms(text: Column) -> tuple[Column, Column]:
    """Words and pairs of words; and pieces of three to five characters of each word with a blank at both ends."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
    pairs = F.zip_with(words, F.slice(words, 2, 1_000_000), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.when(F.size(words) > 1, F.slice(pairs, F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<string>"))
    padded = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def pieces(n: int) -> Column:
        starts = lambda w: F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1)))
        return F.flatten(F.transform(padded, lambda w: F.transform(starts(w), lambda i: w.substr(i, F.lit(n)))))

    return F.concat(words, pairs), F.concat(*(pieces(n) for n in (3, 4, 5)))


def featured(rows: DataFrame) -> DataFrame:
    words, pieces = terms(F.coalesce("text", F.lit("")))
    return rows.withColumns({"words": words, "pieces": pieces})


def balanced(rows: DataFrame) -> DataFrame:
    """``weight``: rows over classes times the class's rows, so that classes count alike."""
    classes = rows.groupBy("category_id").agg(F.count("*").alias("_n"))
    total = classes.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_classes"))
    weights = classes.join(F.broadcast(total)).select("category_id", (F.col("_rows") / (F.col("_classes") * F.col("_n"))).alias("weight"))  # one row of totals
    return rows.join(F.broadcast(weights), "category_id")  # a row for each class; rows of a small file would look the smaller side


def guard(train: DataFrame, test: DataFrame, least_train: int = LEAST_TRAIN, least_test: int = LEAST_TEST) -> str | None:
    """Why a split can't be used: too few rows in a part, or one class only in training."""
    n, classes = train.agg(F.count("*"), F.count_distinct("category_id")).first()
    if n < least_train:
        return "too_few_training_samples"
    return "one_class_training_split" if classes < 2 else "too_few_test_samples" if test.count() < least_test else None


def fit(train: DataFrame, seed: int = 17) -> PipelineModel:
    stages = []
    for kind in ("words", "pieces"):
        stages += [CountVectorizer(inputCol=kind, outputCol=f"{kind}_n", vocabSize=FEATURES), IDF(inputCol=f"{kind}_n", outputCol=f"{kind}_w"), Normalizer(inputCol=f"{kind}_w", outputCol=f"{kind}_v")]
    labels = StringIndexer(inputCol="category_id", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    stages += [VectorAssembler(inputCols=["words_v", "pieces_v"], outputCol="features"), labels, LogisticRegression(maxIter=100, regParam=1e-3, weightCol="weight")]
    stages.append(IndexToString(inputCol="prediction", outputCol="guess", labels=labels.labels))
    return Pipeline(stages=stages).fit(balanced(featured(train)))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the likeliest category ``guess`` and its ``confidence``."""
    held = featured(rows).withColumn("weight", F.lit(1.0))
    held = held if "category_id" in rows.columns else held.withColumn("category_id", F.lit(""))
    scored = model.transform(held).withColumn("confidence", F.array_max(vector_to_array("probability")))
    return scored.select(*rows.columns, "guess", "confidence")


def evaluated(train: DataFrame, test: DataFrame) -> DataFrame:
    """``model`` (candidate or baseline, the most frequent class of training) with its overall metrics on the test part."""
    most = train.groupBy("category_id").count().orderBy(F.desc("count"), "category_id").limit(1).select(F.col("category_id").alias("guess"))
    guesses = predict(fit(train), test).select(F.lit("candidate").alias("model"), F.col("category_id").alias("label"), "guess")
    guesses = guesses.unionByName(test.join(F.broadcast(most)).select(F.lit("baseline").alias("model"), F.col("category_id").alias("label"), "guess"))  # one row
    cells = cut(guesses.groupBy("model", "label", "guess").agg(F.count("*").alias("n")))  # at most the square of the classes
    each = [training.overall_metrics(training.class_metrics(cells.filter(F.col("model") == m))).withColumn("model", F.lit(m)) for m in ("candidate", "baseline")]
    return each[0].unionByName(each[1])


def selected(*evaluations: DataFrame) -> bool:
    """Whether the candidate beats the baseline in macro F1 and is no worse in weighted F1, on every holdout."""
    for found in evaluations:
        of = {r.model: r for r in found.collect()}
        if of["candidate"].macro_f1 <= of["baseline"].macro_f1 or of["candidate"].weighted_f1 < of["baseline"].weighted_f1:
            return False
    return True


def structure(model: PipelineModel) -> list[str]:
    return [type(stage).__name__.removesuffix("Model") for stage in model.stages]


def digest(model: PipelineModel) -> str:
    """SHA-256 of what the model computes with: vocabularies, weights, labels."""
    fields = [s.vocabulary for s in model.stages if hasattr(s, "vocabulary")]
    regression = next(s for s in model.stages if hasattr(s, "coefficientMatrix"))
    fields += [next(s.labels for s in model.stages if hasattr(s, "labelsArray")), regression.coefficientMatrix.toArray().round(12).tolist(), regression.interceptVector.toArray().round(12).tolist()]
    return hashlib.sha256(json.dumps(fields).encode()).hexdigest()


def save(model: PipelineModel, path: str, taxonomy_version: str) -> None:
    """The model and, beside it, what loading checks; an existing model is not replaced."""
    spark = SparkSession.active()
    model.write().save(f"{path}/model")
    spark.createDataFrame([(digest(model), taxonomy_version)], "digest string, taxonomy_version string").coalesce(1).write.json(f"{path}/metadata")


def load(spark, path: str, taxonomy_version: str) -> PipelineModel:
    """The stored model, if its taxonomy, structure and content are those it was stored with."""
    told = spark.read.schema("digest string, taxonomy_version string").json(f"{path}/metadata").first()
    model = PipelineModel.load(f"{path}/model")
    if told.taxonomy_version != taxonomy_version:
        raise ValueError("the model was trained on another taxonomy")
    if tuple(structure(model)) != STAGES or digest(model) != told.digest:
        raise ValueError("the stored model is not the one that was saved")
    return model
