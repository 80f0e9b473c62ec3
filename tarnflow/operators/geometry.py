"""Mesh geometry of a raster: points, texture coordinates, normals, and a drape of another column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.field import with_neighbours
from tarnflow.sources.grid import Raster


def _kept(n: int, factor: float) -> list[int]:
    from math import ceil, floor

    return list(range(1, n + 1)) if factor <= 1 else [min(n, floor(k * factor)) for k in sorted({ceil(i / factor) for i in range(1, n + 1)})]


def mesh_geometry(raster: Raster, *, downsample: float = 1.0, height: float = 1.0) -> DataFrame:
    """Vertices of the mesh: i, j (from 1 after downsampling), x, y, z, u, v and the unit normal
    (nx, ny, nz) from central differences of the unscaled heights, one-sided at the edges."""
    rows, cols = _kept(raster.nrows, downsample), _kept(raster.ncols, downsample)
    spark = raster.cells.sparkSession
    cells = raster.cells.select("i", "j", F.col("z").alias("z0"))
    if downsample > 1:
        ri = spark.createDataFrame([(k + 1, r) for k, r in enumerate(rows)], "ni long, i long")
        cj = spark.createDataFrame([(k + 1, c) for k, c in enumerate(cols)], "nj long, j long")
        cells = cells.join(F.broadcast(ri), "i").join(F.broadcast(cj), "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "z0")
    step = lambda n, m: n / (m - 1) if m > 1 else 0.0
    dx, dy = step(raster.nrows, len(rows)), step(raster.ncols, len(cols))
    near = with_neighbours(cells, ["z0"], diagonals=False)
    a, b = F.col("z0") - F.col("n0.z0"), F.col("n1.z0") - F.col("z0")
    c, d = F.col("z0") - F.col("n2.z0"), F.col("n3.z0") - F.col("z0")
    gx = (F.coalesce(a, b) + F.coalesce(b, a)) / (2 * dx) if dx else F.lit(0.0)
    gy = (F.coalesce(c, d) + F.coalesce(d, c)) / (2 * dy) if dy else F.lit(0.0)
    out = near.withColumn("_gx", gx).withColumn("_gy", gy).withColumn("_n", F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2 + 1))
    x, y = (F.col("i") - 1) * F.lit(dx), (F.col("j") - 1) * F.lit(dy)
    return out.select(
        "i", "j", x.alias("x"), y.alias("y"), (F.col("z0") * height).alias("z"), (x / raster.nrows).alias("u"), (y / raster.ncols).alias("v"),
        (F.col("_gx") / F.col("_n")).alias("nx"), (F.col("_gy") / F.col("_n")).alias("ny"), (1 / F.col("_n")).alias("nz"),
    )


def mesh_faces(nrows: int, ncols: int, spark) -> DataFrame:
    """Quads (a, b, c, d) of vertex numbers i + (j - 1) * nrows."""
    a = F.col("i") + (F.col("j") - 1) * nrows
    ij = spark.range(1, nrows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(ncols - 1).cast("long"))).alias("j")) if ncols > 1 else spark.createDataFrame([], "i long, j long")
    return ij.select(a.alias("a"), (a + 1).alias("b"), (a + 1 + nrows).alias("c"), (a + nrows).alias("d"))


def drape(mesh: DataFrame, texture: DataFrame, value: str) -> DataFrame:
    """The mesh with another texture value by (i, j); vertices without one get null."""
    return mesh.join(texture.select("i", "j", F.col(value).alias("texture")), ["i", "j"], "left")
