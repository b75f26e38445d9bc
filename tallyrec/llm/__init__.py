"""Operations for preparing language-model training data.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; ``queries.py`` applies each of them to its whole table.
"""
