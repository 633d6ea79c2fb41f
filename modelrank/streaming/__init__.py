"""Keeping answers fresh as data arrives."""
