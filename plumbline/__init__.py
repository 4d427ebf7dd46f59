"""plumbline: retrieval, ranking evaluation and selective-answer calibration on Spark DataFrames.

Everything works set-at-a-time: all questions against the whole corpus in one plan. The
subpackages are ``operators`` (the building blocks), ``functions`` (column expressions),
``sources`` (readers and writers), ``streaming`` (incremental ingest) and ``plans`` (the
registered queries with their SQL). ``llm`` holds the training-data operators; nothing in
the other subpackages imports it.
"""

__version__ = "0.1.0"
