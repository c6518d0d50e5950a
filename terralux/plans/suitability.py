"""The two land pipelines (R9): comparison run and site selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralux.operators import overlay, quality, sites
from terralux.operators.energy import enrich_sites
from terralux.operators.exclusions import apply_exclusions, with_excluded
from terralux.operators.reclassify import with_scores
from terralux.registry import Registry
from terralux.session import cut

# What the site run extracts.
SITE_CLASSES = (5, 4)
SITE_CAP_KM2 = 50.0


def score_cells(cells: DataFrame, registry: Registry, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores, LSI and exclusions: one narrow projection over the cells.

    Adds ``excluded``, ``lsi_raw`` and ``lsi`` (missing where excluded).
    """
    scored = overlay.with_lsi(with_scores(with_excluded(cells, registry), registry), registry, weights)
    kept = [c for c in scored.columns if not c.startswith("s_") and c != "lsi"]
    return scored.select(
        *kept, F.col("lsi").alias("lsi_raw"), apply_exclusions(F.col("lsi"), F.col("excluded")).alias("lsi")
    )


def classified_cells(cells: DataFrame, registry: Registry, method: str = "equal_interval") -> DataFrame:
    """Scored cells with ``lsi_class``; class bounds are per scene."""
    return overlay.classify(score_cells(cells, registry), ["scene_id"], method)


def comparison(cells: DataFrame, registry: Registry) -> dict[str, DataFrame]:
    """Equal-interval class shares of every scene, exclusion counts and the published comparison."""
    classified = classified_cells(cells, registry)
    distribution = overlay.class_distribution(classified, ["scene_id"], registry)
    return {
        "distribution": distribution,
        "exclusions": overlay.exclusion_summary(classified, ["scene_id"]),
        "comparison": overlay.compare_with_published(distribution, ["scene_id"]),
    }


def select_sites(
    cells: DataFrame,
    grids: DataFrame,
    registry: Registry,
    method: str = "quantile",
    weather: DataFrame | None = None,
    top_k: int | None = sites.TOP_K,
) -> dict[str, DataFrame]:
    """Quantile classes, capped regions of the two top classes, energy per site and checks."""
    wanted = ["scene_id", "row", "col", "x", "y", "lsi", "lsi_class"]
    extra = [c for c in ("dist_power", "ghi_annual") if c in cells.columns]
    classified = cut(classified_cells(cells, registry, method).select(*wanted, *extra), "classified")
    ranked, member = sites.extract_with_cells(
        classified, grids, SITE_CLASSES, max_site_area_km2=SITE_CAP_KM2, top_k=top_k
    )
    enriched = enrich_sites(ranked, classified, grids, weather)
    return {
        "sites": enriched,
        "members": member,
        "notes": quality.site_notes(enriched, quality.bounds_table(cells.sparkSession)),
        "framing": quality.framing_note(enriched),
    }
