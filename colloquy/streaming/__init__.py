"""Transcripts as a stream."""
