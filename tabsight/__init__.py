"""tabsight — automated table analysis on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames (plus a fitted Spark ML
model where one is trained).  Sub-packages:

* ``sources``   — reading / writing tables and models
* ``functions`` — column-expression building blocks (JVM side, codegen friendly)
* ``operators`` — profiling, outliers, text, series, features, models,
  evaluation, clustering, projection, anomaly detection
* ``plans``     — composed analyses (preprocessing, report facts) and the
  registry of named queries used by the driver contract

"""

from tabsight.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
