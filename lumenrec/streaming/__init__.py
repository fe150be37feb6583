"""The recommendation queries over streams of interactions."""
