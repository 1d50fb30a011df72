"""Record-pipeline operators."""
