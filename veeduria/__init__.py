"""veeduria: procurement red-flag analytics on Spark.

Reads contract records, normalises buyer and supplier identities, evaluates a
registry of statistical red flags, rolls alerts up into 0-100 risk scores and
answers the reporting questions around them. Every operator is a
``DataFrame -> DataFrame`` function built from Spark SQL built-ins.

A flag is a statistical signal that calls for human review, never an
accusation.
"""

from veeduria.session import get_spark, ensure_checkpoint_dir  # noqa: F401
from veeduria.params import Params  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir", "Params"]
