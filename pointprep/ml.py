"""A text classifier on character n-grams, and model settings.

It stands for fine-tuning a pretrained transformer, which needs weights and accelerators that are not here: same
inputs (text, label_id), same outputs (logits, then prediction rows and metrics).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short names of models.
ALIASES = {
    "deberta-v3-base": "microsoft/deberta-v3-base",
    "deberta-v3-small": "microsoft/deberta-v3-small",
    "deberta-v3-large": "microsoft/deberta-v3-large",
    "roberta-base": "FacebookAI/roberta-base",
    "roberta-large": "FacebookAI/roberta-large",
}


def model_name(alias: str) -> str:
    return ALIASES.get(alias, alias)


def effective_batch(batch: int, accumulation: int) -> int:
    return batch * accumulation


def fit(train: DataFrame, features: int = 1 << 14, rounds: int = 20, decay: float = 1e-3) -> PipelineModel:
    stages = [
        RegexTokenizer(inputCol="text", outputCol="c_", pattern="", gaps=True, toLowercase=True, minTokenLength=1),
        NGram(n=2, inputCol="c_", outputCol="g_"),
        HashingTF(inputCol="g_", outputCol="features", numFeatures=features),
        LogisticRegression(featuresCol="features", labelCol="label_id", maxIter=rounds, regParam=decay),
    ]
    return Pipeline(stages=stages).fit(train.where("text is not null and label_id is not null"))


def parameters(model: PipelineModel) -> int:
    """Number of fitted weights."""
    last = model.stages[-1]
    return last.coefficientMatrix.numRows * last.coefficientMatrix.numCols + last.interceptVector.size


def logits(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(text, label_id, logits) of every row."""
    return model.transform(rows).select("text", "label_id", vector_to_array(F.col("rawPrediction")).alias("logits"))
