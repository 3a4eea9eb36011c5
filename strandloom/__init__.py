"""strandloom: genomic tables and training-corpus jobs as Spark DataFrame operators."""
