"""Reading datasets, populations, registers and series; writing results."""
