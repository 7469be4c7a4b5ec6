"""automill: pattern-automata analytics on PySpark."""
