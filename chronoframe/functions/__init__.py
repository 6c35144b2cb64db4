"""Part of chronoframe."""
