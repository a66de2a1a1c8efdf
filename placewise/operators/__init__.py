"""Operators: DataFrame in, DataFrame out.

They are lazy but for three things: counting a lookup table before it is
broadcast, checkpoints of small tables that are read several times, and fitting.
"""
