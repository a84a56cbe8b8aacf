"""pixelframe: Earth-observation cubes, benchmark histories and catalogues as Spark DataFrames."""
