"""riskset - survival and cohort analytics on Spark DataFrames.

Every public operator takes DataFrames and returns DataFrames (or a small
fitted-parameter object). Heavy work runs as Spark aggregates, joins and
windows; Python on the driver only touches bounded results such as
parameter vectors, level lists and p x p matrices.
"""

__version__ = "0.1.0"
