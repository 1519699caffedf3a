"""tallyframe: curate, audit and evaluate large item catalogues with Spark DataFrames."""
