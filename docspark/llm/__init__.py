"""Corpus preparation for language-model training; the rest of the library never imports it."""
