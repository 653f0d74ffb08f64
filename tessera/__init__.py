"""tessera: cohort analytics and risk models as Spark jobs.

Operators take and return DataFrames.  Subpackages:

sources    CSV / JSON / Parquet scans, sinks, synthetic cohorts
functions  column expressions (parsing, clipping, stable hashing)
operators  data quality, aggregation, joins, sampling, features, models, metrics
plans      whole jobs made of operators: cohort preparation, training, scoring
streaming  Structured Streaming counterparts
"""

__version__ = "0.1.0"
