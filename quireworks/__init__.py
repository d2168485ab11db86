"""quireworks: document-layout analytics on Spark DataFrames."""
