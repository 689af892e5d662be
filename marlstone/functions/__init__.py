"""Marlstone functions."""
