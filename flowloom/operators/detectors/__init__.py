"""Supervised classifiers and anomaly detectors with one small interface.

``fit(df)`` returns a model; ``model.predict(df)`` adds ``guess`` (1 = attack) and ``score`` (higher
means more attack-like).
"""

from flowloom.operators.detectors.base import SingularData
from flowloom.operators.detectors.envelope import EllipticEnvelope
from flowloom.operators.detectors.forest import IsolationForest
from flowloom.operators.detectors.lof import LocalOutlierFactor
from flowloom.operators.detectors.oneclass import OneClassSVM
from flowloom.operators.detectors.supervised import DecisionTree, NaiveBayes, RandomForest

__all__ = ["DecisionTree", "EllipticEnvelope", "IsolationForest", "LocalOutlierFactor",
           "NaiveBayes", "OneClassSVM", "RandomForest", "SingularData"]
