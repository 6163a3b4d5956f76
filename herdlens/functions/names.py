"""Node roles and feature classes by name: plans are built on the driver from these."""

from __future__ import annotations

import re

# The names that body parts go by, in order of preference.
ROLES = {
    "body": ("centermass", "bodycenter", "bodycentre", "center_mass"),
    "nose": ("nose",),
    "ear_l": ("earl", "ear_left", "ear_l", "left_ear", "el"),
    "ear_r": ("earr", "ear_right", "ear_r", "right_ear", "er"),
    "hip_l": ("hindlegl", "hip_left", "hip_l", "left_hip", "hl"),
    "hip_r": ("hindlegr", "hip_right", "hip_r", "right_hip", "hr"),
    "tail_base": ("tailstart", "tail_base", "tailbase", "tb"),
    "tail_mid": ("tailmid", "tail_mid", "tailmiddle", "tm"),
    "tail_end": ("tailend", "tail_end", "te"),
}
# Behaviours whose columns are flags, and the words in names of other features, in the order of asking.
FLAGS = frozenset(
    "stationary walking running turning dir_reversal nosenose nosehead nosebody noserear contact cooriented antioriented engaged disengaged "
    "hh ho sniff follow chase flee approach activeavoid passiveavoid stationaryprox socialorient visualattn auditoryattn".split()
)
CLASSES = (
    ("velocity", ("curvature",)),
    ("angular", ("_angle", "ang_mot", "angular_motion", "heading", "approach_angle")),
    ("jerk", ("jerk",)),
    ("velocity", ("speed", "_vx", "_vy", "displacement")),
    ("acceleration", ("accel",)),
    ("shape", ("elongation", "eccentricity", "compactness", "circularity", "hourglass", "path_eff", "position_entropy", "total_disp")),
    ("distance", ("dist", "area", "covar", "corr")),
    ("categorical", ("relpos", "visual_scope", "auditory_scope")),
)


def strip_digits(name: str) -> str:
    return re.sub(r"[0-9]+$", "", name)


def find_node(names: list[str], role: str) -> int | None:
    """Index of the node of that role: by alias in order of preference, digits at the end apart; else by substring."""
    lower = [n.lower() for n in names]
    plain = [strip_digits(n) for n in lower]
    for alias in ROLES.get(role, ()):
        if alias in plain:
            return plain.index(alias)
    return next((i for i, n in enumerate(lower) if role.lower() in n), None)


def tail_end_nodes(names: list[str], middle: bool = False) -> list[int]:
    """Tail tips; a bare `tail` is one if the skeleton has a tail start as well. With `middle` also what is between."""
    plain = [strip_digits(n.lower()) for n in names]
    start, some = any(n in ROLES["tail_base"] for n in plain), (*ROLES["tail_end"], *(ROLES["tail_mid"] if middle else ()))
    return [i for i, n in enumerate(plain) if n in some or (n == "tail" and start)]


def column_name(node: str) -> str:
    return node.replace(" ", "_")


def find_distance(columns: list[str], a: tuple[str, ...], b: tuple[str, ...]) -> str | None:
    """The first of the columns that is a distance (ends in _dist) between a node that has one of the words `a` in its
    name and one that has one of `b`. Case doesn't matter; None if there is none."""
    low = [(c, c.lower()) for c in columns if c.endswith("_dist")]
    return next((c for c, n in low if any(x.lower() in n for x in a) and any(x.lower() in n for x in b)), None)


def feature_class(name: str, flags: frozenset[str] = FLAGS) -> str:
    """Which aggregates a feature's bins get. Flags go by their whole name without subject and direction, so no part of
    a node's name makes a flag."""
    n = name.lower()
    if n.endswith(("_x", "_y")):
        return "position"
    if re.sub(r"_[ab]to[ab]$", "", n.rpartition("/")[2]) in flags:
        return "binary"
    return next((kind for kind, words in CLASSES if any(w in n for w in words)), "other")


def unit(name: str, px_per_cm: float) -> tuple[str, float]:
    """(unit, factor from pixels) of a feature."""
    kind, cm = feature_class(name), 1 / px_per_cm
    if "area" in name.lower():
        return "cm2", cm * cm
    return {
        "distance": ("cm", cm), "position": ("cm", cm), "velocity": ("cm/s", cm), "acceleration": ("cm/s2", cm),
        "jerk": ("cm/s3", cm), "angular": ("deg", 1.0),
    }.get(kind, ("", 1.0))


def frames(seconds: float, fps: float, least: int = 0) -> int:
    """A span in frames, by Python's rounding of halves to even."""
    return max(least, round(seconds * fps))
