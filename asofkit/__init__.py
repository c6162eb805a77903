"""asofkit: leakage-safe features and rolling-origin backtests as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) plus column names and returns a
DataFrame (or a Column). The driver sees counts, coefficients and other tables whose size is
bounded by folds, columns or calendar days, never rows of the data.
"""

__version__ = "0.1.0"
