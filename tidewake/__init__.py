"""Membership-inference analytics over large text corpora, as Spark DataFrames."""
