"""Cleaning, text scoring and classification of survey-style tables on Spark."""

__version__ = "0.1.0"
