"""Record-pipeline streaming."""
