"""dqspark: data-quality operators expressed as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame (lazy plan); none
collects data to the driver.  Sub-packages:

* ``functions``  - Column -> Column expressions (parsing, severity, text helpers)
* ``sources``    - readers, catalog, sinks (insert-or-ignore, upsert, prune)
* ``operators``  - profiling, drift, rules, registry joins, audits, traces
* ``plans``      - registered queries over the test tables + DuckDB oracle SQL
* ``streaming``  - Structured Streaming forms of the stateful operators
"""

__version__ = "0.1.0"
