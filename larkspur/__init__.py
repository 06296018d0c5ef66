"""Larkspur: workforce-compliance analytics and corpus preparation as Spark jobs."""
