"""tillroll: online-shop analytics as PySpark DataFrame operators.

Layers
------
``sources``    typed CSV landing, Parquet tables, test-table binding
``functions``  column-level helpers (exact rounding, day arithmetic, shares)
``operators``  reusable DataFrame -> DataFrame building blocks
               (integrity checks, distributed ranking / quantiles, fact blocks)
``plans``      the analytical jobs (monthly, category, repeat, delivery, RFM,
               summary, chart data sets)
``streaming``  incremental landing of newly arriving CSV files
"""

__version__ = "0.1.0"
