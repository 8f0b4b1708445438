"""Fitted operators on a stream."""
