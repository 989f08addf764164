"""Patchwright: text segmentation, alignment and experiment analytics on Spark DataFrames."""
