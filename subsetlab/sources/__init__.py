"""Sources of event records, and the archive of what they gave."""
