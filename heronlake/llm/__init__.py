"""Operators of a training-data pipeline; nothing else in heronlake imports this subpackage."""
