"""Files that hold sequences and expected answers, read and written by Spark."""
