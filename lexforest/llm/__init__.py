"""Training-data operators: ten corpus operators and their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
