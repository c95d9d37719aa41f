"""Scriven: text similarity and text forensics on Spark DataFrames."""
