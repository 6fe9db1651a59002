"""Input tables and their mapping to the audit model."""
