"""Part of the quillspan engine."""
