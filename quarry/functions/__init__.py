"""Part of quarry; see the README for the map of the packages."""
