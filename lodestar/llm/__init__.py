"""Operations of a large-scale training-data pipeline, on Spark DataFrames.

Nothing outside this package (but for ``corpus_pipeline.py``) imports it.
"""
