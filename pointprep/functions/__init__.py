"""Part of pointprep."""
