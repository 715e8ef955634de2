"""Part of sparseloom."""
