"""Operators: index look-ups, Boolean queries, query building, ranking, evaluation, analysis, language model."""
