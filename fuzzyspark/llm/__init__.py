"""Operators of a training-data pipeline.

Every operator takes a DataFrame (plus parameters) and returns a DataFrame;
``queries`` binds them to the tables of a folder.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
