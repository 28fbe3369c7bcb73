"""quarry: tabular quality modelling as Spark DataFrame jobs.

Every operator takes and returns a lazy DataFrame. Fitted operators first
compute their statistics with one batched aggregate (or one distributed sort
for exact order statistics) and then apply a single projection.
"""

from quarry.session import get_session  # noqa: F401

__all__ = ["get_session"]
