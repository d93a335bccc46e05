"""Operation logs from tables and from binary updates."""
