"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="bx int, by int, bz int, x0 int, y0 int, z0 int, nx int, ny int, nz int, values array<float>")
class Bricks:
    """Cut a flat array of a volume ``shape`` into bricks of at most ``size`` per axis."""

    def eval(self, values: list, shape: list, size: int):
        import numpy as np

        volume = np.asarray(values, dtype=np.float32).reshape(shape)
        for x0 in range(0, shape[0], size):
            for y0 in range(0, shape[1], size):
                for z0 in range(0, shape[2], size):
                    block = volume[x0 : x0 + size, y0 : y0 + size, z0 : z0 + size]
                    place = (x0 // size, y0 // size, z0 // size, x0, y0, z0)
                    yield (*place, *block.shape, block.ravel().tolist())


def register(spark: SparkSession) -> None:
    spark.udtf.register("bricks", Bricks)
