"""Training-data operators over text tables: one module for each operator.

Nothing outside this package imports it; ``llm.queries`` registers its queries.
"""
