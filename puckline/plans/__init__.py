"""End-to-end jobs over a landing zone and a season-partitioned warehouse."""
