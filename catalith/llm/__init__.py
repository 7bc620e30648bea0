"""Training-data operators: ten distributed corpus operators and their registered queries.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
