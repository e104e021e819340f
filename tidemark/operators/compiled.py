"""Fitted models as SQL expressions over the columns they were fitted on.

The text is plain arithmetic and CASE, so a model can be scored inside generated code, in a view, or by another engine; `SPARK` and
`DUCKDB` differ only in how names, texts and the text type are written. Encoders and scalers are part of the expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoderModel, StandardScalerModel, StringIndexerModel, VectorAssembler
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    quote: str
    text: str
    escape: str

    def name(self, column: str) -> str:
        return f"{self.quote}{column.replace(self.quote, self.quote * 2)}{self.quote}"

    def string(self, value: str) -> str:
        if self.escape == "\\":
            value = value.replace("\\", "\\\\")
        return "'" + value.replace("'", self.escape + "'") + "'"


SPARK = Dialect("`", "STRING", "\\")
DUCKDB = Dialect('"', "VARCHAR", "'")


def number(value: float) -> str:
    """A literal that both engines read as a double of exactly this value."""
    shown = repr(float(value))
    return shown if "e" in shown else f"{shown}E0"


def feature_texts(features: PipelineModel | Sequence[str], dialect: Dialect = SPARK) -> list[str]:
    """The expression of every entry of the feature vector, for a pipeline of `feature_stages` or plain columns."""
    if not isinstance(features, PipelineModel):
        return [f"CAST({dialect.name(c)} AS DOUBLE)" for c in features]
    made: dict[str, list[str]] = {}
    categories: dict[str, tuple[str, list[str]]] = {}
    for stage in features.stages:
        if isinstance(stage, StringIndexerModel):
            for source, out, labels in zip(stage.getInputCols(), stage.getOutputCols(), stage.labelsArray):
                categories[out] = source, list(labels)
        elif isinstance(stage, OneHotEncoderModel):
            for index, out in zip(stage.getInputCols(), stage.getOutputCols()):
                source, labels = categories[index]
                # the place after the last known value is dropped, so other values are zero throughout
                made[out] = [f"CASE WHEN CAST({dialect.name(source)} AS {dialect.text}) = {dialect.string(v)} THEN 1E0 ELSE 0E0 END" for v in labels]
        elif isinstance(stage, VectorAssembler):
            parts = [made.get(c, [f"CAST({dialect.name(c)} AS DOUBLE)"]) for c in stage.getInputCols()]
            made[stage.getOutputCol()] = [text for part in parts for text in part]
        elif isinstance(stage, StandardScalerModel):
            mean, std = stage.mean.toArray(), stage.std.toArray()
            made[stage.getOutputCol()] = [
                f"(({text} - {number(m)}) * {number(1.0 / s if s else 0.0)})" for text, m, s in zip(made[stage.getInputCol()], mean, std)
            ]
        else:
            raise ValueError(f"{type(stage).__name__} has no expression")
    return made["features"]


def linear_text(coefficients: Sequence[float], intercept: float, features: Sequence[str]) -> str:
    terms = [f"{number(c)} * {text}" for c, text in zip(coefficients, features, strict=True) if c]
    return "(" + " + ".join([*terms, number(intercept)]) + ")"


def logistic_text(coefficients: Sequence[float], intercept: float, features: Sequence[str]) -> str:
    """The probability of class 1."""
    return f"(1E0 / (1E0 + exp(-{linear_text(coefficients, intercept, features)})))"


def tree_text(tree: dict[str, np.ndarray], features: Sequence[str]) -> str:
    """Nested CASE over node arrays (feature, -1 in a leaf; threshold; left; right; value)."""
    done: dict[int, str] = {}
    waiting = [0]
    while waiting:  # children first, without recursion: trees may be deep
        node = waiting[-1]
        feature = int(tree["feature"][node])
        if feature < 0:
            done[node] = number(tree["value"][node])
            waiting.pop()
            continue
        left, right = int(tree["left"][node]), int(tree["right"][node])
        missing = [c for c in (left, right) if c not in done]
        if missing:
            waiting += missing
            continue
        done[node] = f"CASE WHEN {features[feature]} <= {number(tree['threshold'][node])} THEN {done.pop(left)} ELSE {done.pop(right)} END"
        waiting.pop()
    return done[0]


_RULE = re.compile(r"(If|Else) \(feature (\d+) (<=|>|in|not in) (.*)\)$")


def printed_trees(text: str) -> list[tuple[float, dict[str, np.ndarray]]]:
    """Weights and node arrays of the trees in a model's printed form (`toDebugString`), which holds every number in full.

    A set of two-valued categories becomes the threshold between 0 and 1.
    """
    trees: list[tuple[float, dict[str, list]]] = []
    path: list[int] = []

    def begin(weight: float) -> None:
        trees.append((weight, {k: [] for k in ("feature", "threshold", "left", "right", "value")}))
        path.clear()

    def node(feature: int, threshold: float, value: float) -> int:
        arrays = trees[-1][1]
        for key, item in (("feature", feature), ("threshold", threshold), ("left", -1), ("right", -1), ("value", value)):
            arrays[key].append(item)
        at = len(arrays["value"]) - 1
        while path:
            parent = path[-1]
            if arrays["left"][parent] == -1:
                arrays["left"][parent] = at
                break
            if arrays["right"][parent] == -1:
                arrays["right"][parent] = at
                break
            path.pop()
        return at

    turned: set[tuple[int, int]] = set()
    for line in map(str.strip, text.splitlines()):
        if line.startswith("Tree "):
            begin(float(line.split("weight ")[1].rstrip("):")))
            continue
        rule = _RULE.match(line)
        if not rule and not line.startswith("Predict: "):
            continue
        if not trees:
            begin(1.0)
        if not rule:
            node(-1, 0.0, float(line[9:]))
        elif rule[1] == "If":
            if rule[3] == "in":
                values = {float(v) for v in rule[4].strip("{}").split(",")}
                if values not in ({0.0}, {1.0}):
                    raise ValueError(f"categories {values} have no threshold")
                at = node(int(rule[2]), 0.5, float("nan"))
                if values == {1.0}:
                    turned.add((len(trees) - 1, at))
            else:
                at = node(int(rule[2]), float(rule[4]), float("nan"))
            path.append(at)
    for i, at in turned:
        arrays = trees[i][1]
        arrays["left"][at], arrays["right"][at] = arrays["right"][at], arrays["left"][at]
    return [(weight, {k: np.asarray(v) for k, v in arrays.items()}) for weight, arrays in trees]


def ensemble_text(trees: Sequence[tuple[float, dict[str, np.ndarray]]], features: Sequence[str], mean: bool = False) -> str:
    """Weighted sum of trees, or their mean."""
    total = " + ".join(f"{number(weight)} * ({tree_text(tree, features)})" for weight, tree in trees)
    return f"(({total}) / {number(sum(w for w, _ in trees))})" if mean else f"({total})"


def model_text(model, features: Sequence[str]) -> str:
    """The prediction of a fitted linear, logistic (probability of class 1), tree, forest or boosted model."""
    kind = type(model).__name__
    if kind == "LinearRegressionModel":
        return linear_text(model.coefficients.toArray(), model.intercept, features)
    if kind == "LogisticRegressionModel":
        return logistic_text(model.coefficients.toArray(), model.intercept, features)
    if kind in ("DecisionTreeRegressionModel", "RandomForestRegressionModel", "GBTRegressionModel"):
        return ensemble_text(printed_trees(model.toDebugString), features, mean=kind == "RandomForestRegressionModel")
    raise ValueError(f"{kind} has no expression")


def model_column(model, features: PipelineModel | Sequence[str]) -> Column:
    """The prediction as a column over the columns the feature pipeline starts from."""
    return F.expr(model_text(model, feature_texts(features, SPARK)))
