"""From aggregated cells to ranked cells and the best contiguous zones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from landgrid.functions import hexgrid
from landgrid.operators import scoring, zones
from landgrid.session import cut_lineage


def rank_locations(cells: DataFrame, level: int, templates: list[str], **options) -> DataFrame:
    """Cells scored and ranked for every template; ``options`` go to ``score_cells``."""
    inputs = scoring.cell_inputs(cells, hexgrid.area_km2(level))
    scored = scoring.score_cells(inputs, ["cell", "muni_code"], templates, **options)
    return scoring.rank_cells(scored, "cell", ["template"])


def best_zones(ranked: DataFrame, level: int, **options) -> DataFrame:
    """The best zones per template; ``options`` go to ``top_zones``."""
    slim = ranked.select("template", "cell", "score", "confidence", "excluded")
    return zones.top_zones(cut_lineage(slim), level, **options)
