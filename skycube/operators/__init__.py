"""DataFrame operators on cubes, inventories, quality tables and candidates."""
