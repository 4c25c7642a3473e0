"""Operators for building language-model training data; nothing outside this folder imports them."""
