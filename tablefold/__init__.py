"""tablefold: table-task datasets, answer scoring and table operators on Spark.

Subpackages
-----------
sources    readers and writers (case tables, responses, prompts, reports) and
           the derived test inputs built from the shared parquet tables
functions  column-expression building blocks (answer extraction, JSON values,
           the 25 task scorers, token counting)
operators  DataFrame -> DataFrame operators (cells, serialisers, prompts,
           budget, sampling, metrics, analysis, profiling, comparison,
           discovery, reshaping, matching, cleaning)
plans      named end-to-end queries over a data directory
streaming  incremental result intake and the running scoreboard
"""

__version__ = "0.1.0"
