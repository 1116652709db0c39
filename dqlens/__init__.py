"""A Spark-native data-quality engine: semantic schemas, detectors and drift on DataFrames."""

from .config import Config, build_config
from .engine import compare, inspect, inspect_schema, inspect_train_test, investigate
from .findings import Finding, Report
from .operators.rules import Rule as ColumnRule
from .sources.load import Dataset, LoadError, load, register_adapter

__all__ = ["ColumnRule", "Config", "Dataset", "Finding", "LoadError", "Report", "build_config", "compare", "inspect", "inspect_schema", "inspect_train_test", "investigate", "load", "register_adapter"]
