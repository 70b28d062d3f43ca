"""codeloom: source code and web pages as a property graph, queried with Spark DataFrames."""
