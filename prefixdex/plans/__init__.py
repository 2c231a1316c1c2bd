"""Session setup, shared physical-plan helpers and end-to-end jobs."""
