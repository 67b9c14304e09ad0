"""Scalar functions as Column expressions; none runs Python on the executors."""
