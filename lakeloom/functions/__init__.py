"""Part of lakeloom."""
