"""Spark-first analytics over image-annotation tables (COCO-like) and text corpora."""
