"""Operators that prepare text and vectors for language models; nothing outside this folder imports it."""
