"""Multilingual fuzzy search and text matching on Spark."""

VERSION = "0.2.0"
