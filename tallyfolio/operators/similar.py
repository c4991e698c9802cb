"""The upper rungs of classification: a text model with labels, and votes of near vectors (see ``vectors``)."""
from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tallyfolio.operators import vectors as V

MAX_FIT = 20_000


def fit_text_classifier(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14,
                        max_fit: int = MAX_FIT, key: str = "doc_id", documents: DataFrame | None = None) -> PipelineModel:
    """TF-IDF and logistic regression.

    Document frequencies cover all ``documents`` (all labelled rows, if not given); the regression is
    fitted on at most ``max_fit`` labelled rows (smallest key hashes).
    """
    body = F.coalesce(F.col(text), F.lit("")).alias("_text")
    weights = Pipeline(stages=[RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
                               HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
                               IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=2)]).fit((documents or labelled).select(body))
    chosen = labelled.select(key).orderBy(F.xxhash64(key), key).limit(max_fit).distinct()
    rows = labelled.join(chosen, key, "left_semi").select(body, F.col(label).cast("double").alias("_label"))
    judge = LogisticRegression(featuresCol="_tfidf", labelCol="_label", maxIter=20, regParam=0.01).fit(weights.transform(rows))
    return PipelineModel(stages=[*weights.stages, judge])


def score_texts(model: PipelineModel, documents: DataFrame, text: str = "text") -> DataFrame:
    """Every document with ``probability`` of the label and the ``predicted`` value."""
    out = model.transform(documents.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    return out.select(*documents.columns, vector_to_array("probability")[1].alias("label_probability"),
                      F.col("prediction").cast("int").alias("predicted"))


def nearest_to(vectors: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int = 5, vec_id: str = "vec_id",
               embedding: str = "embedding") -> DataFrame:
    """For each query the ``k`` rows of ``vectors`` of highest cosine, with ``query_id``, ``rank`` and ``similarity``.

    Queries are a table (query_id, embedding) of any size, or a few rows given as they are.
    """
    if not isinstance(queries, DataFrame):
        queries = vectors.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in queries],
                                                       f"query_id bigint, {embedding} array<double>")
    return V.nearest_to(vectors, queries, k, vec_id, embedding, keep=[c for c in vectors.columns if c != vec_id])


def vote(neighbours: DataFrame, label: str = "label") -> DataFrame:
    """The label most of a query's neighbours carry, ties to the smaller label."""
    counted = neighbours.groupBy("query_id", label).agg(F.count("*").alias("votes"))
    best = counted.groupBy("query_id").agg(F.max_by(F.struct(label, "votes"), F.struct("votes", (-F.col(label)).alias("l"))).alias("b"))
    return best.select("query_id", F.col(f"b.{label}").alias(label), "b.votes")
