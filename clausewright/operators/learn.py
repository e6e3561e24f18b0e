"""Trained clause classifiers: splits, TF-IDF with logistic regression, inference, metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright import rules
from clausewright.functions import text as T
from clausewright.operators.classify import accept

FEATURES = 20_000


def label_table(spark: SparkSession, labels: tuple[str, ...] = rules.MODEL_LABELS) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, label_id int")


def encode_labels(rows: DataFrame, labels: tuple[str, ...] = rules.MODEL_LABELS) -> DataFrame:
    """label_id by the fixed order; an unknown label is an error."""
    ids = F.create_map(*(F.lit(x) for pair in zip(labels, range(len(labels))) for x in pair))
    return rows.withColumn("label_id", F.coalesce(F.element_at(ids, F.col("label")), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))).cast("int")))


def stratified_split(rows: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Rows with `split`: exactly the given share of each label (rounded up) trains, by a digest of the key. The
    digest is md5, which any engine has. Its first characters are buckets: how many rows of a label stand in earlier
    ones is a sum over counts, so that a label with most of the rows is ranked in many windows."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marked = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring(digest, 1, 3)).withColumn("_label", F.col(label))
    counts = marked.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 4096 rows a label.
    whole = Window.partitionBy("_label")
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_label").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    rank = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_digest", key))
    placed = marked.withColumn("_rank", rank).join(starts, F.col("_label").eqNullSafe(F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    trains = F.col("_before") + F.col("_rank") <= F.ceil(F.col("_total") * F.lit(share))
    return placed.withColumn("split", F.when(trains, "train").otherwise("test")).select(*rows.columns, "split")


def clause_pipeline(label: str = "label", regularisation: float = 0.002, features: int = FEATURES, iterations: int = 40):
    """C11: words and word pairs, IDF, unit length, multinomial logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, SQLTransformer, StringIndexer

    tokens = SQLTransformer(statement="SELECT *, filter(split(lower(regexp_replace(text, '[^A-Za-z0-9 ]', ' ')), ' +'), w -> length(w) > 1) AS _w FROM __THIS__")
    pairs = SQLTransformer(statement="SELECT *, concat(_w, IF(size(_w) > 1, transform(sequence(0, size(_w) - 2), i -> concat(_w[i], ' ', _w[i + 1])), array())) AS _t FROM __THIS__")
    counts = CountVectorizer(inputCol="_t", outputCol="_counts", vocabSize=features)
    weighted = IDF(inputCol="_counts", outputCol="_tfidf")
    unit = Normalizer(inputCol="_tfidf", outputCol="features")
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")
    model = LogisticRegression(featuresCol="features", labelCol="_y", regParam=regularisation, maxIter=iterations, tol=1e-4, family="multinomial", predictionCol="_p", probabilityCol="_probability", rawPredictionCol="_raw")
    return Pipeline(stages=[index, tokens, pairs, counts, weighted, unit, model])


def train(rows: DataFrame, label: str = "label"):
    """Fits the pipeline; returns a function from rows with text to rows with ml_label and ml_confidence."""
    from pyspark.ml.functions import vector_to_array

    model = clause_pipeline(label).fit(rows)
    names = model.stages[0].labels

    def predict(other: DataFrame, least: float | None = None) -> DataFrame:
        fed = other.withColumn(label, F.coalesce(F.col(label), F.lit(names[0])) if label in other.columns else F.lit(names[0]))
        scored = _apply(model, fed)
        found = F.element_at(F.array(*map(F.lit, names)), F.col("_p").cast("int") + 1)
        best = F.round(F.array_max(vector_to_array("_probability")), 4)
        out = scored.withColumn("ml_label", found).withColumn("ml_confidence", best)
        if least is not None:
            out = out.withColumn("ml_label", accept(F.col("ml_label"), F.col("ml_confidence"), least))
        return out.select(*other.columns, "ml_label", "ml_confidence")

    predict.model = model
    return predict


def _apply(model, rows: DataFrame) -> DataFrame:
    """All stages but the label index, which inference has no need of."""
    for stage in model.stages[1:]:
        rows = stage.transform(rows)
    return rows


def no_model(rows: DataFrame) -> DataFrame:
    """C12 without a trained model: other at 0."""
    return rows.withColumn("ml_label", F.lit("other")).withColumn("ml_confidence", F.lit(0.0))


def predict_with(rows: DataFrame, logits: Callable[[pd.Series], np.ndarray], labels: tuple[str, ...] = rules.MODEL_LABELS, least: float = 0.30, batch: int = 16) -> DataFrame:
    """Any sequence model: logits for a batch of texts, softmax, argmax; under `least` the label is other."""

    @F.pandas_udf("struct<ml_label:string,ml_confidence:double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(texts), batch):
            raw = np.asarray(logits(texts.iloc[at : at + batch]), dtype=np.float64)
            p = np.exp(raw - raw.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            out += [(labels[i], round(float(row[i]), 4)) for row, i in zip(p, p.argmax(axis=1))]
        return pd.DataFrame(out, columns=["ml_label", "ml_confidence"])

    scored = rows.withColumn("_m", run("text"))
    return scored.select(*rows.columns, accept(F.col("_m.ml_label"), F.col("_m.ml_confidence"), least).alias("ml_label"), F.col("_m.ml_confidence").alias("ml_confidence"))


def confusion(predicted: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n)."""
    return predicted.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def metrics(matrix: DataFrame) -> DataFrame:
    """C17: accuracy, and precision, recall and F1 weighted by the rows of each true label, to 4 places. From the
    confusion matrix alone, whose size is the square of the labels."""
    per_truth = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hits"))
    per_guess = matrix.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    both = per_truth.join(per_guess, "label", "left").withColumn("guessed", F.coalesce("guessed", F.lit(0)))
    precision = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(0.0)
    recall = F.col("hits") / F.col("support")
    named = both.withColumn("p", precision).withColumn("r", recall).withColumn("f", F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0))
    weighed = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 4)
    return named.agg(F.round(F.sum("hits") / F.sum("support"), 4).alias("accuracy"), weighed("p").alias("precision"), weighed("r").alias("recall"), weighed("f").alias("f1"))


def labelled_paragraphs(paragraphs: DataFrame, label: str = "label") -> DataFrame:
    """Training rows from detected clauses: blank and unlabelled ones left out."""
    return paragraphs.filter((T.strip(F.col("text")) != "") & F.col(label).isNotNull())
