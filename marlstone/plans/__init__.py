"""Marlstone plans."""
