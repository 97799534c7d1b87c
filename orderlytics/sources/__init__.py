"""Loading, seeding, mapping and writing of the five logical tables."""
