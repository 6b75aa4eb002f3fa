"""Lodestone: corpus cataloguing, search, selection and packaging as Spark jobs."""
