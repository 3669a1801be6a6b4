"""Leakage-controlled evaluation of labelled text collections on Spark."""
