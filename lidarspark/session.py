"""A survey session as an immutable value: region, grid, transmitters, antennas."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from .operators.coverage import TX, Grid, add_transmitter, coverage
from .operators.spatial import Box, in_box
from .operators.summaries import cloud_summary, ndjson
from .sources.tables import antenna_configs


@dataclass(frozen=True)
class Survey:
    """Each method returns a new session or a DataFrame; nothing is kept elsewhere."""

    points: DataFrame
    region: Box | None = None
    grid: Grid | None = None
    txs: DataFrame | None = field(default=None, compare=False)
    configs: str | None = None

    @property
    def loaded(self) -> DataFrame:
        return in_box(self.points, self.region) if self.region else self.points

    def load_box(self, x: float, y: float, radius: float) -> Survey:
        return replace(self, region=Box.around(x, y, radius), grid=None)

    def set_grid(self, resolution: float = 2.0, margin: float = 20.0) -> Survey:
        if resolution <= 0 or margin < 0:
            raise ValueError("the resolution must be positive and the margin not negative")
        return replace(self, grid=Grid.over(self.loaded, resolution, margin))

    def antennas(self) -> DataFrame:
        return antenna_configs(self.points.sparkSession, self.configs)

    def reload_configs(self, path: str | None) -> Survey:
        return replace(self, configs=path)

    def add_tx(self, x: float, y: float, **given) -> Survey:
        now = self.txs if self.txs is not None else self.points.sparkSession.createDataFrame([], TX)
        return replace(self, txs=add_transmitter(now, self.loaded, self.antennas(), x=float(x), y=float(y), **given))

    def clear_txs(self) -> Survey:
        return replace(self, txs=None)

    def summary(self) -> DataFrame:
        return cloud_summary(self.loaded)

    def stream(self) -> DataFrame:
        return ndjson(self.loaded)

    def simulate(self) -> DataFrame:
        """The raster of received power; needs points and a transmitter."""
        grid = self.grid or Grid.over(self.loaded)
        if grid is None:
            raise ValueError("load a region with points first")
        if self.txs is None:
            raise ValueError("add a transmitter first")
        return coverage(self.loaded, self.txs, grid)
