"""Job configuration: topology, modes, validation."""
