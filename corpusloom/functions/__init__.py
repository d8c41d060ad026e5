"""Scalar functions: as Spark columns, and as plain Python where a fold over a document needs them."""
