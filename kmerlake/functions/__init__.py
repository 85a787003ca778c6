"""Column expressions over sequences, markers and result cells."""
