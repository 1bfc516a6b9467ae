"""Registry of queries, and the tables that they derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rasters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of the tables under ``name``; ``sql`` gives the same rows in DuckDB."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return put


class Tables:
    """The given tables as attributes, and derived ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def points(self) -> DataFrame:
        """Events at places all over the world."""
        return self.events.select("event_id", "ts", "user_id", "event_type", "value", "props", F.expr("((event_id*7919) % 36000)/100e0 - 180e0 + 0.003e0").alias("lng"), F.expr("((event_id*104729) % 16000)/100e0 - 80e0 + 0.003e0").alias("lat"))

    @property
    def city(self) -> DataFrame:
        """Events close together."""
        return self.events.select("event_id", "ts", "event_type", "value", F.expr("-74e0 + ((event_id*31) % 97)/1000e0 + 0.0003e0").alias("lng"), F.expr("40.7e0 + ((event_id*17) % 89)/1000e0 + 0.0003e0").alias("lat"))

    @property
    def boxes(self) -> DataFrame:
        """A box and a hexagonal ring around its centre for each nation."""
        b = self.nation.select("n_nationkey", "n_name", F.expr("-180e0 + (n_nationkey % 6)*60").alias("minx"), F.expr("-64e0 + (n_nationkey div 6)*26").alias("miny"))
        b = b.withColumn("maxx", F.expr("minx + 10e0")).withColumn("maxy", F.expr("miny + 8e0"))
        return b.withColumn("ring", F.expr("array(" + ", ".join(f"named_struct('x', minx + {x}e0, 'y', miny + {y}e0)" for x, y in RING) + ")"))

    @property
    def ids(self) -> DataFrame:
        """Events with a 64-bit hexagon id of resolution 9 made of the digits of their number."""
        return self.events.select("event_id", "value", F.expr(f"{H3_SQL}").alias("h"))

    @property
    def pixels(self) -> DataFrame:
        """A raster block of 64 values for each part, as pixel rows without nodata."""
        blocks = rasters.dealt(self.part.select("p_partkey"), 64, "p_partkey").select("p_partkey", F.expr("transform(sequence(0, 63), j -> (p_partkey * j) % 11)").alias("v"))
        return blocks.select("p_partkey", F.posexplode("v").alias("i", "data")).where("data <> 0").withColumn("x", F.expr("i % 8")).withColumn("y", F.expr("i div 8"))


RING = [(0, 4), (2.5, 0), (7.5, 0), (10, 4), (7.5, 8), (2.5, 8)]
_digits = " + ".join(f"((event_id // {7**r}) % 7) * {1 << 3 * (14 - r)}" for r in range(9))
H3_DUCK = f"(cast(576460752303423488 as bigint) + cast({9 << 52} as bigint) + (event_id % 122) * cast({1 << 45} as bigint) + {_digits} + {(1 << 18) - 1})"
H3_SQL = H3_DUCK.replace("//", "div")
POINTS = "(select *, ((event_id*7919) % 36000)/100e0 - 180e0 + 0.003e0 as lng, ((event_id*104729) % 16000)/100e0 - 80e0 + 0.003e0 as lat from events)"
CITY = "(select *, -74e0 + ((event_id*31) % 97)/1000e0 + 0.0003e0 as lng, 40.7e0 + ((event_id*17) % 89)/1000e0 + 0.0003e0 as lat from events)"
BOXES = "(select *, minx + 10e0 as maxx, miny + 8e0 as maxy from (select n_nationkey, n_name, -180e0 + (n_nationkey % 6)*60 as minx, -64e0 + (n_nationkey // 6)*26 as miny from nation))"
IDS = f"(select event_id, value, {H3_DUCK} as h from events)"
PIXELS = "(select p_partkey, i, (p_partkey * i) % 11 as data, i % 8 as x, i // 8 as y from part, range(64) r(i) where (p_partkey * i) % 11 <> 0)"


def tx(z: int, lng: str = "lng") -> str:
    return f"cast(floor(({lng} + 180e0) / 360e0 * {1 << z}e0) as bigint)"


def ty(z: int, lat: str = "lat") -> str:
    return f"cast(floor((1e0 - ln(tan(radians({lat})) + 1e0/cos(radians({lat})))/pi())/2e0 * {1 << z}e0) as bigint)"


def tc(z: int, lng: str = "lng", lat: str = "lat") -> str:
    """The packed tile in DuckDB."""
    return f"(cast({z << 56} as bigint) + {tx(z, lng)} * {1 << 28} + {ty(z, lat)})"


def up(z: int, to: int, cell: str = "cell") -> str:
    """The parent tile in DuckDB."""
    return f"(cast({to << 56} as bigint) + ((({cell} >> 28) & {(1 << 28) - 1}) >> {z - to}) * {1 << 28} + (({cell} & {(1 << 28) - 1}) >> {z - to}))"
