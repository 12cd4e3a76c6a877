"""Run records, what is rendered from them, and the measurements they hold."""
