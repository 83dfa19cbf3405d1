"""Part of the sparkcohort engine."""
