"""Operators for preparing text for language models. Nothing outside this folder imports it."""
