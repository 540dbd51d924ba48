"""tallystack: DataFrame operators for cleaning, fact-table assembly, feature
engineering, profiling, binary classification and its evaluation on Spark.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column``) and names its columns through parameters, so it works on any table.
"""

from tallystack.session import get_session, shared_dir, bounded_broadcast

__all__ = ["get_session", "shared_dir", "bounded_broadcast"]
