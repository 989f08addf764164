"""Operators for training-data preparation (language, form, leakage, duplicates, ...).

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
