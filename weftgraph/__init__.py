"""weftgraph: full-graph analytics and graph-network training as Spark jobs."""
