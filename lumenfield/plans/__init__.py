"""Viewer plans and the registered queries."""
