"""quarry: semantic-layer and evaluation analytics as plain Spark DataFrame plans.

Sub-packages:
  sources    - table access, file readers/sinks, derived evaluation inputs, contracts
  plans      - entity/relationship bindings, graph projection, question templates, truth
  functions  - Column -> Column scoring expressions (no UDFs)
  operators  - scorecards, run comparison, evidence packing, tuning-log analytics, skew-safe helpers
  streaming  - incremental graph refresh with Structured Streaming
"""

__version__ = "0.1.0"
