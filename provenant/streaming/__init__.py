"""Stateful processors over ordered deltas, for streams and, by the same code, for batches."""
