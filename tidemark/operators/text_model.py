"""A sentiment model of one's own: hashed terms and a linear classifier, learned from labelled texts and scored in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import ratio
from tidemark.operators.models import hash_fraction, kept

#: The three labels, in the order of their class numbers.
LABELS = ("negative", "neutral", "positive")
#: Places terms are hashed to, rows a term needs, and the lasso penalty on the weights, which leaves most terms out.
PLACES, LEAST_ROWS, PENALTY = 1 << 17, 4, 0.005
HELD_OUT = 0.3


def class_number(label: Column) -> Column:
    """0, 1, 2 for the labels, null for anything else."""
    number = F.lit(None).cast("double")
    for i, name in enumerate(LABELS):
        number = F.when(label == name, F.lit(float(i))).otherwise(number)
    return number


def with_part(df: DataFrame, keys: Sequence[str], held_out: float = HELD_OUT, seed: int = 42) -> DataFrame:
    """`is_held_out` by a hash of the keys: those rows judge a model and do not teach it."""
    return df.withColumn("is_held_out", hash_fraction(keys, seed) < held_out)


def text_pipeline(text: str, label: str = "_class") -> Pipeline:
    """Which words and pairs of neighbouring words a text holds, hashed, weighed by rarity; a sparse linear model of the classes.

    Vectors are sparse and of a fixed size, so nothing grows with the vocabulary. A null text counts as empty.
    """
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, coalesce(`{text}`, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}']+", toLowercase=True),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=PLACES, binary=True),
        IDF(inputCol="_counts", outputCol="_weights", minDocFreq=LEAST_ROWS),
        LogisticRegression(featuresCol="_weights", labelCol=label, regParam=PENALTY, elasticNetParam=1.0, predictionCol="_predicted", probabilityCol="_probability", rawPredictionCol="_margin"),
    ])


def fit_text_model(labelled: DataFrame, text: str, label: str) -> PipelineModel:
    """Learn from rows with a text and one of the LABELS; rows with another label or none are left out."""
    rows = labelled.select(F.col(text), class_number(F.col(label)).alias("_class")).where(F.col("_class").isNotNull())
    with kept(rows) as train:
        return text_pipeline(text).fit(train)


def label_texts(model: PipelineModel, df: DataFrame, out: str = "Sentiment") -> DataFrame:
    """The most probable label of every row; null for a null text."""
    text = model.stages[0].getStatement().split("`")[1]
    names = F.array(*[F.lit(name) for name in LABELS])
    scored = model.transform(df)
    label = F.element_at(names, F.col("_predicted").cast("int") + 1)
    return scored.select(*df.columns, F.when(F.col(text).isNotNull(), label).alias(out))


def agreement(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows, share labelled rightly, and the share that always naming the commonest label would get."""
    known = df.where(F.col(actual).isNotNull())
    counts = known.groupBy(*groups, actual).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col(actual) == F.col(predicted)).cast("long")).alias("_right"))
    return counts.groupBy(*groups).agg(
        F.sum("_n").alias("n"), ratio(F.sum("_right"), F.sum("_n")).alias("accuracy"), ratio(F.max("_n"), F.sum("_n")).alias("commonest")
    )
