"""Part of vexil."""
