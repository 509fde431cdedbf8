"""Corpus operators for building language-model training data.

Nothing outside this subpackage imports it; delete the folder (with
``tests/llm`` and ``corpus_pipeline.py``) and the rest of the library works.
"""
