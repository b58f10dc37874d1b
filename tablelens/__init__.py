"""tablelens: profile and compare groups of large tables with Spark DataFrames.

Layout: ``sources`` (delimited text, parquet, report sink), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame statistics),
``plans`` (the three end-to-end analyses), ``streaming`` (the same group
statistics over arriving files).
"""

from tablelens.operators import *  # noqa: F401,F403
from tablelens.operators import __all__ as _ops
from tablelens.session import ensure_checkpoint_dir, get_session, shared_dir

__all__ = [*_ops, "ensure_checkpoint_dir", "get_session", "shared_dir"]
