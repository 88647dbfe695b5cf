"""bendscape: DNA curvature, its symmetry and nucleosome calls as Spark DataFrame transformations."""
