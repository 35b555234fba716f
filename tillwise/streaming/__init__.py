"""Scoring of customers as they arrive."""
