"""Recruiting from streams of reads."""
