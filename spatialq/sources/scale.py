"""How long a unit of the coordinates is, from what came with a data set."""

from __future__ import annotations

#: Fixed values, in micrometres: a capture spot's diameter, and the units of two kinds of files told by their names.
SPOT = 55.0
BY_NAME = ((lambda p: p.endswith(".MOSTA.h5ad"), 25.0), (lambda p: "cosmx" in p.lower() or "nsclc" in p.lower(), 0.12028))
STATED = "coordinate_um_per_unit"


def positive(value: object) -> float | None:
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return x if x > 0 else None


def section(value: object, key: str) -> dict:
    inner = value.get(key) if isinstance(value, dict) else None
    return inner if isinstance(inner, dict) else {}


def um_per_unit(metadata: dict, path: str | None = None) -> float | None:
    """Micrometres a unit: as stated for the whole set, by the file's name, or from the first library that says so.

    A library says it outright, by the length of a pixel, or by a spot's diameter in pixels. What is no
    positive number is passed over; None where nothing is known.
    """
    whole = [section(metadata, k).get(STATED) for k in ("stereo_seq", "mosta")]
    found = [positive(v) for v in whole]
    if path is not None:
        found += [length for test, length in BY_NAME if test(path)]
    for library in section(metadata, "spatial").values():
        factors = section(library, "scalefactors")
        spot = positive(factors.get("spot_diameter_fullres"))
        found += [positive(section(library, "metadata").get(STATED)), positive(factors.get("microns_per_pixel")), SPOT / spot if spot else None]
    return next((x for x in found if x), None)
