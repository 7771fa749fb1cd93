"""Part of coordframe."""
