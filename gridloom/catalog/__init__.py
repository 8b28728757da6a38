"""Registered queries: one module for each family of operators, with the SQL that checks them."""

from gridloom.catalog import dense, grids, images, meshes, particles, points, radar, solvers, sparse

FAMILIES = (points, dense, sparse, solvers, grids, meshes, particles, radar, images)

QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items()}
