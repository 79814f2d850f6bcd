"""quillspark: text-corpus and catalogue analytics on Spark DataFrames."""
