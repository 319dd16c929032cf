"""Panel research on Spark: bars -> indicators -> panel -> ensemble -> portfolio -> costed ledger.

Every operator is a function ``f(DataFrame, ..., params) -> DataFrame``.
"""
