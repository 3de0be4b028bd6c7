"""Part of the directory analytics engine."""
