"""Point-in-time research on (date, entity) panels, expressed as Spark plans."""
