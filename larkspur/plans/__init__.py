"""The registry of operations, their frames and their SQL."""
