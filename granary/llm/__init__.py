"""Training-data operators: one module per operator, plus `queries` that registers them.

Nothing outside this subpackage (and `corpus_pipeline.py`) imports it.
"""
