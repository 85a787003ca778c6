"""kmerlake: sequence and k-mer analytics as Spark DataFrame plans."""
