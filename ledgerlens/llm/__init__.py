"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds the
queries of :mod:`ledgerlens.llm.queries` when it is present.
"""
