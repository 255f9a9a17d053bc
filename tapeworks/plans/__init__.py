"""Whole studies composed from the operators: labelling, feature tables, back-tests, comparisons."""
