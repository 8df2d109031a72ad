"""Operators for training-data pipelines over text.

One module per problem; ``queries`` and ``oracle`` of :mod:`tomeflow.llm.registry` are
what ``__spark_entry__`` adds when this subpackage can be imported.  Nothing outside
this subpackage imports it.
"""
