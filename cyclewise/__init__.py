"""cyclewise: run-to-failure fleet telemetry analytics on Spark DataFrames.

Every operator takes and returns DataFrames; fitted state (scalers, centroids,
reference statistics, thresholds) is itself a small DataFrame of parameters.
"""

from cyclewise.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
