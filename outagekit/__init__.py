"""outagekit: supply-interruption analytics as Spark DataFrame jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, windows, joins and aggregations, so Catalyst plans
the work and it scales out with the cluster.
"""

from outagekit.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
