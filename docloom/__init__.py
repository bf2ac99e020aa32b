"""Grounded document analytics on Spark: text, retrieval, grounding, planning, evaluation, layout and streaming."""
