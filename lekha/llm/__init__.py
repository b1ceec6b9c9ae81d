"""Operators for preparing language-model training data.

Nothing else in the package imports this folder. ``queries`` registers one
query per operator; ``corpus_pipeline`` at the repository root chains five.
"""
