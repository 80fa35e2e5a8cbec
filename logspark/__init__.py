"""Log intelligence on PySpark: triage, detect, explain, forecast and train over DataFrames."""

from logspark.operators.anomaly import detect_cascade as detect
from logspark.operators.explain import explain
from logspark.operators.forecast import forecast
from logspark.operators.models import train_detector as train
from logspark.plans.triage import triage
from logspark.session import get_spark

__all__ = ["detect", "explain", "forecast", "get_spark", "train", "triage"]
