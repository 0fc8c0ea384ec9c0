"""Column expressions: hash sampling, scalars, calendar and behaviour scores."""
