"""Part of the obsforge engine."""
