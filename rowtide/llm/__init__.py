"""Operations for preparing large text corpora.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns a DataFrame; the thin queries that apply them to whole tables are in
``queries.py``.
"""
