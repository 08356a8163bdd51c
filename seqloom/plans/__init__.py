"""Whole analyses built from operators."""
