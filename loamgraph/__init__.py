"""loamgraph: knowledge-graph retrieval and analytics expressed as Spark DataFrames."""
