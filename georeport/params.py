"""Tunable values of the jobs. The defaults are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scoring:
    """Weights of the unary and pairwise place scores."""

    frontline_weight: float = 1.0
    direction_weight: float = 1.0
    compactness_weight: float = 2.0
    close_km: float = 15.0
    far_km: float = 50.0
    region_same: float = 1.0
    region_differ: float = 1.0
    group_same: float = 0.5
    group_differ: float = 0.25


# Phrase shapes around a gazetteer name: (label, words before, words after).
DIRECTION_TEMPLATES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("DIRECTION", ("in", "the", "direction", "of"), ()),
    ("DIRECTION", ("towards",), ()),
    ("DIRECTION", (), ("direction",)),
    ("DIRECTION", (), ("axis",)),
    ("DIRECTION", (), ("sector",)),
    ("DIRECTION", ("the",), ("line",)),
    ("PROXIMITY", ("near",), ()),
)


# Short forms whose dot does not end a sentence, in lower case.
ABBREVIATIONS = ("gen", "col", "lt", "maj", "capt", "sgt", "dr", "mr", "mrs", "st", "ген", "обл")


@dataclass(frozen=True)
class Params:
    scoring: Scoring = field(default_factory=Scoring)
    beam_width: int = 50
    max_bbox_km: float = 30.0
    proximity_radius_km: float = 50.0
    proximity_keep: int = 5
    min_similarity: float = 0.0
    min_translation_length: int = 40
    section_split_chars: int = 800
    post_context_tokens: int = 12
    section_context_chars: int = 40
    templates: tuple = DIRECTION_TEMPLATES
    abbreviations: tuple[str, ...] = ABBREVIATIONS
