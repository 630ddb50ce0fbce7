"""A property-graph analytics engine on PySpark: files to graph, graph to rows."""
