"""Windows and state over event streams; each takes a batch or a streaming DataFrame."""
