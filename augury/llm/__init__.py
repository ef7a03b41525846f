"""Training-data pipeline operators.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; ``__spark_entry__`` adds its
queries only when it is there.
"""
