"""Seed classifiers of event category and segment type (English), and the gates that let them overrule the rules.

Both are the same Spark ML pipeline: words, word pairs and letter trigrams, and multinomial logistic regression. They are
fitted on the seed examples below, or on any DataFrame of (text, label), and applied as columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, IndexToString, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORY_LEAST, TYPE_LEAST, TYPE_SURE = 0.55, 0.60, 0.90
CATEGORIES, TYPES = ("Past", "Present", "Future"), ("NAR", "REM", "SUP", "GEN", "FIC")

# Seed examples.
CATEGORY_SEEDS: dict[str, list[str]] = {
    "Past": [
        "Years earlier Karl had carried Adam through the rain", "She remembered her mother in Jakarta", "He was five years old", "Before he came here",
        "Long ago Margaret lived in another house", "Karl had been imprisoned", "The soldiers left yesterday", "Adam recalled the orphanage",
    ],
    "Present": [
        "This is Adam", "Now he is sixteen", "She waits in the kitchen", "Adam searches for Margaret",
        "Margaret finds Adam at the doorway", "Karl travels alone across the island", "The narrator describes the house", "They are walking to the truck",
    ],
    "Future": [
        "Adam will find Margaret", "She would return before dawn", "He is going to leave soon", "Karl might come back",
        "They shall meet tomorrow", "The soldiers could arrive later", "Margaret would have escaped", "The child will remember this",
    ],
}
TYPE_SEEDS: dict[str, list[str]] = {
    "NAR": [
        "Adam walked through the market.", "Margaret opened the door.", "Karl travelled across the island.", "The soldiers arrived before noon.", "She waited in the kitchen.",
        "He searched for Margaret after the storm.", "They entered the house together.", "The boy crossed the street and stopped near the gate.",
        "Adam and Johan grew up in the same house.", "Adam disappeared before dawn.", "Meanwhile, Karl traveled alone across the island.",
    ],
    "REM": [
        "Years earlier, Karl had carried Adam through the rain.", "Margaret remembered her mother.", "She recalled the words from childhood.", "Back then Adam lived in the orphanage.",
        "Long ago he had met Johan.", "He dreamed of his father's old house.", "In the past, she had waited for him there.", "The old voice returned from memory.",
    ],
    "SUP": [
        "Perhaps Adam would find her.", "She imagined that Karl might return.", "If only he could have stayed.", "He supposed the road might be safe.",
        "They might meet again before dawn.", "She believed he would have escaped.", "Maybe the soldiers had already left.", "It could have happened another way.",
    ],
    "GEN": [
        "People usually remember home by its smells.", "Everyone knows that islands change slowly.", "The sea always takes back what it is given.", "Children generally fear dark rooms.",
        "A person never knows the end of a journey.", "Mothers usually wait for letters.", "Stories often preserve what families forget.", "Time always moves differently in exile.",
    ],
    "FIC": [
        "In the story the prince crossed a river.", "In the film the city burned all night.", "The fictional detective found a hidden map.", "The invented kingdom had no clocks.",
        "In the play Margaret spoke to a stranger.", "The novel described an impossible war.", "The movie showed a child walking through fire.", "Inside the tale, the island floated away.",
    ],
}
# End of fixed values.


def seeds(spark: SparkSession, examples: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(t, label) for label, texts in examples.items() for t in texts], "text string, label string")


def fit(examples: DataFrame, regularisation: float = 0.002) -> PipelineModel:
    """A pipeline that adds ``predicted`` and the class probabilities to (text, ...)."""
    letters = RegexTokenizer(inputCol="text", outputCol="_letters", pattern="(?s).", gaps=False)
    stages = [RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+"), NGram(n=2, inputCol="_words", outputCol="_pairs"), letters, NGram(n=3, inputCol="_letters", outputCol="_thirds")]
    parts = []
    for name in ("_words", "_pairs", "_thirds"):
        stages += [CountVectorizer(inputCol=name, outputCol=f"{name}_c"), Normalizer(inputCol=f"{name}_c", outputCol=f"{name}_n")]
        parts.append(f"{name}_n")
    stages += [VectorAssembler(inputCols=parts, outputCol="_features"), StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc")]
    train = Pipeline(stages=stages).fit(examples)
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", family="multinomial", regParam=regularisation, probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw").fit(train.transform(examples))
    back = IndexToString(inputCol="_prediction", outputCol="predicted", labels=train.stages[-1].labels)
    return PipelineModel(stages=[*train.stages[:-1], lr, back])


def scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """A function that adds predicted and score, clamped and rounded to 4 places, to rows with text."""

    def add(rows: DataFrame) -> DataFrame:
        out = model.transform(rows).withColumn("score", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.array_max(vector_to_array("_probability")))), 4))
        return out.select(*rows.columns, "predicted", "score")

    return add


def category_model(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    return scorer(fit(seeds(spark, CATEGORY_SEEDS)))


def type_model(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    return scorer(fit(seeds(spark, TYPE_SEEDS)))


def _row(label: Column, score: Column, source: str) -> Column:
    return F.struct(label.alias("label"), score.cast("double").alias("confidence"), F.lit(source).alias("source"))


def category_gate(predicted: Column, score: Column, rule: Column) -> Column:
    """struct(label, confidence, source): a prediction counts if it is known, sure enough, and doesn't contradict a tense that rules have seen."""
    back = lambda why: _row(rule, F.lit(0.0), f"heuristic_fallback_{why}")
    return (
        F.when(predicted.isNull() | score.isNull(), _row(rule, F.lit(0.0), "heuristic_fallback"))
        .when(~predicted.isin(*CATEGORIES), back("unknown_ml_label"))
        .when(score < CATEGORY_LEAST, back("low_ml_confidence"))
        .when((rule != "Present") & (predicted != rule), back("explicit_tense"))
        .otherwise(_row(predicted, score, "mlnet_event_temporal_model"))
    )


def segment_gate(predicted: Column, score: Column, rule: Column) -> Column:
    """struct(label, confidence, source): as for categories; a very sure prediction overrules any rule."""
    back = lambda why: _row(rule, F.lit(0.0), f"heuristic_fallback_{why}")
    return (
        F.when(predicted.isNull() | score.isNull(), _row(rule, F.lit(0.0), "heuristic_fallback"))
        .when(~predicted.isin(*TYPES), back("unknown_ml_label"))
        .when(score < TYPE_LEAST, back("low_ml_confidence"))
        .when((rule != "NAR") & (predicted != rule) & (score < TYPE_SURE), back("conflict"))
        .otherwise(_row(predicted, score, "mlnet_seed_model"))
    )
