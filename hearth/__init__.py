"""hearth — estate operations analytics on Spark.

Jobs are plain ``DataFrame → DataFrame`` functions over a mapping of the
estate tables (see :mod:`hearth.schemas`):

* :mod:`hearth.operators.reports`   — dashboards, listings, rollups, overviews
* :mod:`hearth.operators.billing`   — pricing, bill generation, payments, ledger
* :mod:`hearth.operators.changes`   — change batches and their follow-on effects
* :mod:`hearth.operators.integrity` — data-quality rules
* :mod:`hearth.streaming`           — payment batches arriving as a stream
"""

__version__ = "0.1.0"
