"""Operators of a training-data pipeline: near duplicates, media columns, token counts, toxicity,
URL filters, token files, language-model scores, decontamination, licence scans and mixing.

Nothing outside this subpackage imports it.
"""
