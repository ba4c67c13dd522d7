"""Training-data operators: token files, quality, near-duplicates, mixing,
language-model scoring, decontamination, line and passage dedup, chat format.

Nothing outside this folder imports it. ``queries.py`` registers one thin
query per operator; ``corpus_pipeline.py`` at the repository top chains five
of them.
"""
