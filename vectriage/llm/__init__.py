"""Operators for preparing language-model training text at corpus scale.

Each module holds one operator with its own general interface; ``queries``
registers one thin query per operator.  Nothing outside this folder imports
it except the guarded registration in ``__spark_entry__.py`` and
``corpus_pipeline.py``.
"""
