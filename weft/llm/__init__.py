"""Training-data operators: deduplication, scans, scoring, mixing, packing and vector search.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; long jobs cut their lineage with Parquet tables written below
``spark.checkpoint.dir`` so that lost executors only cost the tasks they ran.
"""
