"""Views and whole queries."""
