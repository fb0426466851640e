"""Part of cubelume; see README.md."""
