"""allelix — group-aware classification of labelled records on Spark.

Layout:
  sources/    readers, sinks, stage store, model store
  functions/  Column-expression builders (labels, sequence, rules, math)
  operators/  DataFrame -> DataFrame operators (features, split, metrics, ...)
  plans/      model fitting, search, hold-out, fairness, the stage driver
  streaming/  stateless scoring on readStream
"""

__version__ = "0.1.0"
