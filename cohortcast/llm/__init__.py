"""Training-data operators: tokenising, scoring, decontamination, near-duplicates, secrets, filters and token files.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
