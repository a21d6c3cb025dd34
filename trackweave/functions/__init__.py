"""Part of the tracking engine."""
