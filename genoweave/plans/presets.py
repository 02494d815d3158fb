"""Seed shapes, presets and parameters of build, dist and search."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Shape:
    """Spaced seed patterns of one weight; each a tuple of offsets."""

    weight: int
    patterns: tuple[tuple[int, ...], ...]

    @property
    def span(self) -> int:
        return max(p[-1] for p in self.patterns) + 1


def parse_shape(text: str) -> Shape:
    """"w:o,o,...[;o,o,...]": at most four patterns; one whose offsets aren't w many is left out; none left is an error."""
    head, _, body = text.partition(":")
    weight = int(head)
    found = [tuple(int(o) for o in part.split(",")) for part in body.split(";") if part.strip()]
    kept = tuple(p for p in found if len(p) == weight and len(p) <= 12)[:4]
    if not kept:
        raise ValueError(f"no usable pattern in seed shape {text!r}")
    return Shape(weight, kept)


@dataclass(frozen=True)
class GeneParams:
    min_orf: int = 30
    window: int = 300
    coding_filter: bool = True


@dataclass(frozen=True)
class DistParams:
    """Options of a comparison. The defaults are those of a run without preset."""

    shape: str = "6:0,2,3,4,5,6"
    scaled: int = 10
    gene_scaled: int = 1
    max_seed_occ: int = 0
    min_aai: float = 0.01
    min_orf_cov: float = 0.2
    min_chain_seeds: int = 2
    xdrop: int = 15
    max_evalue: float = 0.1
    max_pair_matches: int = 32_000_000
    chain_band: int = 25
    chain_max_qgap: int = 500
    min_aligned: int = 0
    min_matched_orfs: int = 0
    min_chain_aligned_aa: int = 0
    aggressive_filter: bool = False
    skip_rbh: bool = False


@dataclass(frozen=True)
class SearchParams:
    marker_shape: str = "6:0,2,3,4,5,6"
    factor: int = 2
    candidates: int = 20
    top: int = 1
    max_posting: int = 400
    background: int = 256
    batch_refs: int = 0
    exclude_self: bool = False


_MILLION = 1_000_000
# Name -> seed shape, one in c, least ORF coverage, most anchors of a pair (millions)
_PRESETS = {
    "small-ultra": ("4:0,1,3,4", 1, 0.0, 32),
    "small-sensitive": ("4:0,1,3,4", 2, 0.0, 32),
    "small-normal": ("4:0,1,4,5", 8, 0.0, 8),
    "small-fast": ("6:0,2,3,4,5,6", 12, 0.0, 2),
    "med-sensitive": ("5:0,1,3,4,5", 2, 0.0, 32),
    "med-normal": ("6:0,2,3,4,5,6", 8, 0.1, 8),
    "med-fast": ("6:0,1,2,4,5,6", 30, 0.1, 2),
    "large-sensitive": ("6:0,2,3,4,6,7", 2, 0.1, 32),
    "large-normal": ("6:0,2,3,4,5,6", 8, 0.1, 8),
    "large-fast": ("6:0,2,3,4,5,6", 20, 0.1, 2),
    "xl-sensitive": ("6:0,2,3,4,6,7", 4, 0.1, 32),
    "xl-normal": ("8:0,1,2,3,4,5,6,9", 8, 0.1, 8),
    "xl-fast": ("7:0,2,3,4,5,6,7", 20, 0.1, 2),
}
# Family -> marker shape, thinning factor
_MARKERS = {
    "small": ("6:0,2,3,4,5,6", 2),
    "med": ("8:0,1,2,3,4,5,6,9", 16),
    "large": ("10:0,1,2,3,4,5,6,7,8,9", 256),
    "xl": ("10:0,1,2,3,4,5,6,7,8,9", 1024),
}
DEFAULT_PRESET = {"api": "med-normal", "search": "small-sensitive"}
NAMES = tuple(_PRESETS)


def dist_params(preset: str | None = None, **explicit) -> DistParams:
    """A preset's options; an option the caller gives wins unless it equals the default of a run without preset."""
    base = DistParams()
    if preset is None:
        return replace(base, **explicit)
    shape, scaled, coverage, millions = _PRESETS[preset]
    chosen = replace(base, shape=shape, scaled=scaled, min_orf_cov=coverage, max_pair_matches=millions * _MILLION, max_evalue=0.001, min_chain_seeds=3 if preset == "small-ultra" else 2)
    return replace(chosen, **{k: v for k, v in explicit.items() if v != getattr(base, k)})


def api_params(preset: str = "med-normal", **explicit) -> DistParams:
    """The function API takes only shape and sampling from a preset; other options have the library's own defaults."""
    shape, scaled, _, _ = _PRESETS[preset]
    own = DistParams(shape=shape, scaled=scaled, max_evalue=0.1, min_orf_cov=0.2, min_aligned=30, min_chain_aligned_aa=20, max_pair_matches=0)
    return replace(own, **explicit)


def search_params(preset: str = "small-sensitive", **explicit) -> SearchParams:
    shape, factor = _MARKERS[preset.split("-")[0]]
    found = replace(SearchParams(marker_shape=shape, factor=factor), **explicit)
    return replace(found, candidates=max(found.candidates, found.top))
