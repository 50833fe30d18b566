"""Plan rewrites: spatial joins as equi-joins on tiles, asynchronous tasks."""
