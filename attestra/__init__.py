"""Attestra: forensic-evidence analytics on PySpark."""
