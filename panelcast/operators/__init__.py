"""DataFrame operators on long panels (id, date, values)."""
