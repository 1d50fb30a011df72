"""Record-pipeline functions."""
