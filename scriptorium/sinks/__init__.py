"""Files for each row, caches and audio."""
