"""loomcast: Spark-native panel forecasting and text operators."""

from loomcast.operators.estimators import BoostedModel, ForestModel, PanelData, TreeModel

__all__ = ["BoostedModel", "ForestModel", "PanelData", "TreeModel"]
