"""Spark-native feature screening and selection by mutual information."""

from gleaner.config import SelectorConfig
from gleaner.estimator import CMIMSelector, InfoSelector, JMIMSelector, MIMSelector, MRMRSelector, SelectorModel
from gleaner.functions.measures import conditional_mi, entropy_from_counts, joint_entropy_from_counts, mutual_information
from gleaner.functions.metrics import auc_binary, auc_macro, r2_score
from gleaner.operators.evaluate import EvaluationReport, GbtFactory, LightgbmFactory, ModelFactory, XgboostFactory, efficiency_curve, make_model_factory, report, train_and_evaluate
from gleaner.operators.knn import ksg_cmi, ksg_mi
from gleaner.stages import FeatureSelector, FeatureSelectorModel

__version__ = "0.1.0"
__all__ = [
    "CMIMSelector", "EvaluationReport", "FeatureSelector", "FeatureSelectorModel", "GbtFactory", "InfoSelector", "JMIMSelector", "LightgbmFactory", "MIMSelector", "MRMRSelector", "ModelFactory",
    "SelectorConfig", "SelectorModel", "XgboostFactory", "auc_binary", "auc_macro", "conditional_mi", "efficiency_curve", "entropy_from_counts",
    "joint_entropy_from_counts", "ksg_cmi", "ksg_mi", "make_model_factory", "mutual_information", "r2_score", "report", "train_and_evaluate",
]
