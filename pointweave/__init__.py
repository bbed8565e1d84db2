"""Ordered record streams on Spark: column codecs, voxel dedup, message sets, containers."""
