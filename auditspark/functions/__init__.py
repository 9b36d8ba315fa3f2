"""Scalar functions: builders of Spark columns, and Arrow functions where Spark has no built-in."""
