"""Training-data operators: filtering, deduplication, mixing and accounting of text corpora.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface; :mod:`matchloom.llm.queries` binds the
operators to the ``documents``/``pages``/``benchmark``/``labels`` tables.
"""
