"""Readers for event batches and the partitioned inbox writer."""
