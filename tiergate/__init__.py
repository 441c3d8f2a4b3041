"""tiergate: confidence-gated multi-tier inference and its evaluation on Spark.

Sub-packages
------------
sources    table scans and sinks (prompt tables, run outputs, emission records, tracker logs, result files)
functions  column-expression helpers (hashing, text cleaning, answer -> label rules, name parsing)
operators  table operators (gate, batching, ranking, metrics, ROUGE, embedding match, energy roll-ups)
plans      end-to-end jobs (cascade sweep / sequential cascade, evaluation, scorer training, curves)
streaming  Structured Streaming versions of the energy roll-up, the gate and de-duplication
"""

__version__ = "0.1.0"
