"""Operators for preparing large text corpora (training data), as Spark jobs.

Nothing else in the library imports this subpackage. Conventions:

* an operator takes and returns DataFrames and names its id / text columns as
  parameters; only those columns are used, so extra input columns, whatever
  their names, neither matter nor clash;
* a row that carries its other columns along is packed as one struct
  (``rows.pack``) and unpacked at the end;
* a frame read by several passes is written once under the shared
  ``spark.checkpoint.dir`` (``medialake.session.materialize``).
"""
