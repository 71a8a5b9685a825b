"""skein: graph analytics and table processing expressed as Spark DataFrames."""
