"""Operators of a training-data pipeline: near-duplicates, tokenizers, quality, archives, decontamination, language models.

Nothing outside this package imports it.  ``queries`` binds the operators to the
driver tables; every other module holds one operator with an interface of its own.
"""
