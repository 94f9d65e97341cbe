"""Whole jobs put together from operators, and the bindings to the driver's tables."""
