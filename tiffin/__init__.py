"""tiffin: food-delivery marketplace analytics as PySpark DataFrame jobs.

Every job is a plain function: DataFrames and keyword parameters in, a lazy
DataFrame out.  No rows are collected to the driver (the only values that
reach it are single row counts proving a join side small enough to
broadcast); the caller decides where the result goes (``df.write``,
``df.show``, a ``noop`` benchmark sink, ...).

Layout
------
``sources``    table schemas, Parquet and catalog (co-bucketed) loading and
               writing, derivation of the five tables from TPC-H-style inputs
               (used by tests, bench and the driver).
``functions``  column-expression helpers (time of day, date ranges, exact money,
               exact rounding) -- all built-in Spark SQL functions, no UDFs.
``operators``  reusable relational building blocks (null-aware NOT IN,
               top-rank filters and distributed ranks, size-checked
               broadcasts, roll-ups through lookup tables, data-quality audits).
``plans``      the catalogue of jobs: table scans, quality audits and the
               thirteen business questions, the query registry and the batch
               report.
``streaming``  the Q2 aggregation run incrementally over a file stream.
"""

__version__ = "0.1.0"
