"""Readers and writers of run tables, judgments and documents."""
