"""panelforge: a Spark-native panel time-series analytics engine.

Daily bars in, features, cross-sectional research, backtests and data-quality
operators out; every operator is a function from DataFrame to DataFrame.
"""

__version__ = "0.1.0"
