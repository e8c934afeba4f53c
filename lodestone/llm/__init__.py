"""Operators that prepare language-model training data. Nothing outside this folder imports it."""
