"""Operators over runs: layout, alignment, checks, judgments, classification, report."""
