"""Part of pliego; see README.md."""
