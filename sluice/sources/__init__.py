"""Record-pipeline sources."""
