"""stratus: Spark-native weather time-series analytics.

Subpackages: ``sources`` (payloads, files, test fixtures), ``functions``
(scalar column helpers), ``operators`` (features, split, scaling, sequences,
alerts, views, metrics, forecast, joins), ``plans`` (MLlib models, batch jobs,
the registered query catalog) and ``streaming`` (alert scoring, incremental
features).  Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
