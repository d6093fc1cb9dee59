"""Operations of a training-data pipeline: filters, tokenizers, classifiers, near duplicates.

Each module holds one operator with a general interface on DataFrames; ``queries`` binds them to the
given tables. Nothing outside this folder imports it.
"""
