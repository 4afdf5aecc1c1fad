"""Fleet patch-evidence analytics on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, joins, windows and ``pyspark.ml``; see README.md for the map from the
operator inventory to modules.
"""

__version__ = "0.1.0"
