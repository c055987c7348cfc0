"""Score bands used by the matching operators."""

from pyspark.sql import Column, functions as F


def similarity_band(score: Column) -> Column:
    """HIGH from 0.95, MEDIUM from 0.85, LOW from 0.70, otherwise NONE."""
    return (
        F.when(score >= 0.95, "HIGH").when(score >= 0.85, "MEDIUM").when(score >= 0.70, "LOW").otherwise("NONE")
    )


def distance_band(distance: Column) -> Column:
    """high under 0.40, medium under 0.55, otherwise none. Takes the unrounded distance."""
    return F.when(distance < 0.40, "high").when(distance < 0.55, "medium").otherwise("none")


def match_confidence(distance: Column, stated: Column | None = None, compat: bool = False) -> Column:
    """Stated confidence, else 1 - distance floored at 0, else 0.5.

    ``compat`` also treats distance 0 as missing.
    """
    known = F.nullif(distance.cast("double"), F.lit(0.0)) if compat else distance.cast("double")
    derived = F.greatest(F.lit(0.0), 1 - F.coalesce(known, F.lit(0.5)))
    return derived if stated is None else F.coalesce(stated.cast("double"), derived)


def face_quality(top: Column, right: Column, bottom: Column, left: Column, height: Column, width: Column) -> Column:
    """Ten times the share of the image the face box covers, at most 1, to 3 places."""
    share = ((right - left) * (bottom - top)) / (height * width)
    return F.round(F.least(F.lit(1.0), share * 10), 3)
