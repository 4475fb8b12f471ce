"""narralytics: comment-corpus and text-generation-evaluation analytics on Spark DataFrames."""
