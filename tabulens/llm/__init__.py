"""Training-data operators: mixing, quality, licences, toxicity, language, BPE, joins, PII, LM scores, ANN.

Nothing else in the package imports this subpackage; its queries live in :mod:`tabulens.llm.queries`.
"""
