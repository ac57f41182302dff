"""cartwise: purchase-intent analytics on Spark.

Clickstream events and time-stamped item properties go in; sessions,
labelled (session, item) pairs, features, MLlib classifiers, top-K
rankings and reports come out. Every operator is a plain
``DataFrame -> DataFrame`` function built from Spark SQL expressions so
that Catalyst plans the whole job.
"""

from cartwise.config import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
__version__ = "0.1.0"
