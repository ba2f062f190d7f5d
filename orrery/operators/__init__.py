"""Joins, aggregates, graph, raster, hull, ray and relation operators: DataFrame in, DataFrame out."""
