"""Readers of sequence, marker, annotation and sample files, and writers of result tables."""
