"""Whole programs: extraction, cruise preparation, training, sweep, audit, onset check."""
