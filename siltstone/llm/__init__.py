"""Training-data operators: everything a corpus pipeline does to ``documents``.

Nothing outside this subpackage (besides ``corpus_pipeline.py``) imports it.
"""
