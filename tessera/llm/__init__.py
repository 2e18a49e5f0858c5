"""Operators of a training-data pipeline: sharding, dedup, scoring, tokens, PII.

Conventions that hold for every operator here:

* Input is any DataFrame with the columns of ``documents``; extra columns pass
  through. An input column named like an output column is replaced by it.
* A null text counts as the empty text unless the operator says otherwise.
* Rows may repeat and ``doc_id`` may be null: rows are never merged or dropped
  on that account. A null ``doc_id`` never represents a group.
* An empty table gives an empty result with the same columns.
* Tables that cut lineage are written to ``spark.checkpoint.dir``.
"""
