"""Tandem: consistency auditing of document pairs, expressed as Spark plans."""

__version__ = "0.1.0"
