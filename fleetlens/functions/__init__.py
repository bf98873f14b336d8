"""Part of fleetlens; see the README for a map of the modules."""
