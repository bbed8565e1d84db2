"""Conversion of message streams."""
