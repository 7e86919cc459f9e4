"""Sources: agreement folders, their files' text, and side tables."""
