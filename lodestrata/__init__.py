"""Spark-first operators for evidence-grounded claim data: profiling, matching, grading, retrieval, looping, scoring."""
