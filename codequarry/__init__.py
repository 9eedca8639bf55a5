"""Code-base analytics on Spark: plain DataFrame functions over files, commits, symbols and edges."""
