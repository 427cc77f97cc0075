"""Training-data operators: chat formatting, line and substring dedup, benchmark
decontamination, SimHash and embedding near-dedup, secret scans, sequence
packing, language-model scoring, quality classification, spelling variants,
ranked lexical search and a store of token ids.

Nothing else in the library imports this subpackage. Each module is one
operator (DataFrame in, DataFrame out); ``queries`` holds the registered thin
queries and ``/corpus_pipeline.py`` chains five of the operators.
"""
