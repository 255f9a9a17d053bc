"""Forecasters built from MLlib estimators and DataFrame steps."""
