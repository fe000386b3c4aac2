"""Operators of a training-data pipeline (each module states its contract).

Nothing else in the library imports this subpackage; the folder, its tests and
``corpus_pipeline.py`` can be deleted together.
"""
