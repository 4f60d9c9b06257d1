"""Operators of a training-data pipeline: deduplication, scans, classifiers,
decontamination, language-model scores and mixing.  Nothing outside this
subpackage imports it."""
