"""Marlstone: panel, risk, segmentation, recommendation and early-warning analytics on PySpark."""
