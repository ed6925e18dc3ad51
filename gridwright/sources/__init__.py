"""Readers, the data set catalogue, sinks and generators."""
