"""Geographic column expressions."""

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0


def great_circle_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance by the spherical law of cosines.

    ``radius * acos(c)`` with ``c = cos(phi1) cos(phi2) cos(dlambda) + sin(phi1) sin(phi2)``.
    ``c`` is clamped to [-1, 1] so rounding noise never yields NaN (the upper
    clamp is what the original statement does; the lower one only guards acos).
    Pure built-ins: stays inside whole-stage codegen.
    """
    lat1, lon1, lat2, lon2 = (_c(x) for x in (lat1, lon1, lat2, lon2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2) - F.radians(lon1)
    cosine = F.cos(p1) * F.cos(p2) * F.cos(dl) + F.sin(p1) * F.sin(p2)
    # greatest/least evaluate the cosine once (a searched CASE would repeat the
    # trig per branch); they skip NULLs, so NULL inputs are handled explicitly.
    clamped = F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, F.lit(radius) * F.acos(clamped))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
