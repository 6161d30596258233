"""Column expressions: UTM, antennas, radio propagation, colours."""
