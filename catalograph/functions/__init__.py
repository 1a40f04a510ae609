"""Part of catalograph."""
