"""tillbook: retail back-office analytics as Spark DataFrame jobs.

Sub-packages:
  sources    - readers, writers, the retail views over the driver tables
  functions  - column-level business rules (pure ``Column -> Column``)
  operators  - reports, joins, windows, loads, posting, quality checks
  plans      - multi-operator jobs (dashboard, invoice posting, product import)
  streaming  - incremental versions on Structured Streaming
"""

__all__ = ["session"]
