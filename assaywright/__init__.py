"""Content-integrity analytics as DataFrame programs."""
